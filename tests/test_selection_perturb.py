"""Selection rules and the documented trajectory change on two vehicles 20 m apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import frames, track
from kinepair import config as cfg
from kinepair.config import PerturbSpec, RiskConfig, scheduled_window
from kinepair.operators import audit, pairs, perturb, selection, tracks
from kinepair.sources.staging import staged

BUILT = {}


def world(spark, speed=0.0, gap=()):
    keep = [t for t in range(110) if t not in gap]
    f = frames(spark, track("a", lambda t: speed * 0.1 * t, vx=speed, steps=keep), track("b", lambda t: 20 + speed * 0.1 * t, vx=speed))
    key = (speed, gap)
    if key not in BUILT:
        nodes = staged(pairs.number_nodes(tracks.build_nodes(f)), "nodes")
        edges = pairs.number_edges(pairs.build_edges(nodes, risk=RiskConfig()))
        BUILT[key] = nodes, staged(selection.with_windows(edges, selection.node_windows(nodes)), "edges")
    return BUILT[key]


def target(spark, window=10):
    return spark.createDataFrame([("s", "a", "b", 0.2, window, 0.5)], "scenario_id string, src_track_id string, dst_track_id string,"
                                                                       " displacement_m double, perturb_window int, allocation_alpha double")


def test_orientation_tie_goes_to_the_smaller_destination_id(spark):
    _, edges = world(spark)
    row = selection.orient_pairs(selection.eligible_orientations(edges)).first()
    assert row.dst_track_id == "a" and row.orientation_candidate_count == 2


def test_contiguity_is_asked_of_the_destination_only(spark):
    _, edges = world(spark, gap=(47,))
    one = selection.eligible_orientations(edges).collect()
    assert [(r.src_track_id, r.dst_track_id) for r in one] == [("a", "b")]
    assert selection.eligible_orientations(edges, both_ends=True).count() == 0


def test_reverse_edge_must_be_supervised(spark):
    _, edges = world(spark)
    cut = edges.withColumn("supervision", F.col("src_track_id") == "a")
    assert selection.eligible_orientations(cut).count() == 0


def test_sample_is_deterministic_and_nested(spark):
    df = spark.range(200).select(F.concat(F.lit("s"), "id").alias("scenario_id"))
    small = {r.scenario_id for r in selection.sample_scenarios(df, 0.05, 7).collect()}
    large = {r.scenario_id for r in selection.sample_scenarios(df.repartition(5), 0.2, 7).collect()}
    assert len(small) == 10 and len(large) == 40 and small < large


def test_preferred_regime_then_hash(spark):
    rows = [("s", "a", "b", cfg.SLOW_REGIME, "f"), ("s", "c", "d", cfg.MOVING_REGIME, "e"), ("s", "e", "f", cfg.MOVING_REGIME, "1"),
            ("r", "a", "b", cfg.MOVING_REGIME, "9")]
    df = spark.createDataFrame(rows, "scenario_id string, pair_lo string, pair_hi string, motion_regime string, selection_priority_sha256 string")
    got = {r.scenario_id: r.pair_lo for r in selection.preferred_pair(df, cfg.MOVING_REGIME).collect()}
    assert got == {"s": "e", "r": "a"}
    assert {r.scenario_id: r.pair_lo for r in selection.preferred_pair(df, cfg.SLOW_REGIME).collect()} == {"s": "a", "r": "a"}
    with pytest.raises(ValueError):
        selection.preferred_pair(df, "other")


def test_ramp_and_window_rules():
    for k in (4, 10):
        p = perturb.ramp(k)
        assert p[-1] == 1.0 and all(np.diff(p) > 0)
    assert scheduled_window(cfg.SLOW_REGIME) == 10 and scheduled_window(cfg.MOVING_REGIME) == 4
    with pytest.raises(ValueError):
        PerturbSpec(window=7)
    with pytest.raises(ValueError):
        scheduled_window("other")


def test_moving_pair_with_four_steps(spark):
    nodes, _ = world(spark, speed=6.0)
    moved = staged(perturb.move_nodes(nodes, perturb.target_moves(target(spark, 4), nodes)), "moved")
    rows = perturb.endpoint_audit(moved).collect()
    assert len(rows) == 2
    for r in rows:
        assert r.terminal_displacement_m == pytest.approx(0.1)
        assert r.max_induced_speed_mps == pytest.approx(0.3964844, abs=1e-5)
        assert r.is_perturbed
    ends = {r.track_id: r.cur_x for r in moved.collect()}
    assert ends["b"] - ends["a"] == pytest.approx(19.8)


def test_allocation_needs_contiguous_source_for_a_share(spark):
    nodes, _ = world(spark, gap=(47,))
    moves = perturb.target_moves(target(spark), nodes, list(cfg.ALPHA_GRID))
    feasible = {r.variant for r in moves.where("feasible").select("variant").distinct().collect()}
    assert feasible == {0.0}


def test_both_directions_are_relabelled_and_marked(spark):
    nodes, edges = world(spark)
    manifest = target(spark).withColumn("poison_label", F.lit(1))
    out = perturb.override_labels(edges, manifest)
    assert [(r.edge_label, r.label_overridden) for r in out.collect()] == [(1, True), (1, True)]
    audit.require(perturb.check_override(out, manifest))
    with pytest.raises(audit.ConstraintError):
        audit.require(perturb.check_override(out.where("src_track_id = 'a'"), manifest))


def test_allocation_scores_and_choice(spark):
    nodes, edges = world(spark)
    moved = staged(perturb.move_nodes(nodes, perturb.target_moves(target(spark), nodes, list(cfg.ALPHA_GRID))), "moved")
    ids = edges.where("src_track_id < dst_track_id").select("scenario_id", F.col("src_track_id").alias("a_track_id"), F.col("dst_track_id").alias("b_track_id"))
    s = perturb.allocation_scores(target(spark), moved, nodes, edges, ids).cache()
    best = perturb.choose_allocation(s).first()
    assert best.allocation_candidate_count == 5
    assert best.total_feature_energy == s.agg(F.min("total_feature_energy")).first()[0]
    assert perturb.symmetric_allocation(s).first().allocation_alpha == 0.5


def good_manifest(spark):
    df = spark.createDataFrame([("s", 0, 1, "a", "b", "train")], "scenario_id string, src int, dst int, src_track_id string, dst_track_id string, split string")
    return selection.fixed_fields(df, 7)


def test_selection_manifest_rules(spark):
    good = good_manifest(spark)
    audit.require(audit.selection_manifest(good))
    for column, value in (("displacement_m", F.lit(0.3)), ("src", F.lit("0.5")), ("require_strict_label", F.lit("maybe")),
                          ("label_config_hash", F.lit("x")), ("poison_label", F.lit(0)), ("perturb_window", F.lit(4))):
        rules = {r.rule for r in audit.selection_manifest(good.withColumn(column, value)).collect()}
        assert rules == {column}
    with pytest.raises(audit.ConstraintError):
        audit.selection_manifest(good.drop("seed"))
    with pytest.raises(audit.ConstraintError):
        audit.require(audit.selection_manifest(good.unionByName(good)))
    half = good.withColumns({"allocation_policy": F.lit(cfg.POLICY_SYMMETRIC), "allocation_alpha": F.lit(0.25)})
    assert {r.rule for r in audit.selection_manifest(half).collect()} == {"allocation_alpha"}


def test_symmetric_candidates_must_match_once(spark):
    keys = "scenario_id string, src int, dst int, src_track_id string, dst_track_id string"
    source = spark.createDataFrame([("x", 0, 1, "a", "b"), ("y", 0, 1, "a", "b")], keys)
    cand = source.withColumn("alpha", F.explode(F.array(F.lit(0.25), F.lit(0.5))))
    audit.require(selection.check_symmetric(source, cand))
    lost = cand.where("not (scenario_id = 'y' and alpha = 0.5)")
    assert [r.rule for r in selection.check_symmetric(source, lost).collect()] == ["candidate_exists"]
    twice = cand.unionByName(cand.where("scenario_id = 'x' and alpha = 0.5"))
    assert [r.rule for r in selection.check_symmetric(source, twice).collect()] == ["unique_candidate"]
