"""Metrics with known values, lanes with awkward input, and file round trips."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from helpers import frames, track
from kinepair.config import RiskConfig
from kinepair.operators import lanes, metrics, pairs, tracks
from kinepair.sources import assets, tables
from kinepair.sources.staging import shared_dir, staged
from kinepair.streaming.arrivals import build_new


def test_collateral_rates_at_two_thresholds(spark):
    rows = [("s", "nonincident_negative", 0.1, 0.6), ("s", "nonincident_negative", 0.4, 0.2), ("s", "adjacent_negative", 0.6, 0.7),
            ("s", "adjacent_positive", 0.8, 0.4), ("s", "adjacent_positive", 0.9, 0.95)]
    members = spark.createDataFrame(rows, "scenario_id string, subset string, p double, q double")
    targets = spark.createDataFrame([("s", "c"), ("empty", "c")], "scenario_id string, city string")
    cells = metrics.transitions(members, targets, "p", "q", {"evaluated_model": 0.5, "common": 0.7})
    assert cells.count() == 2 * 2 * 3 and cells.where("n00 + n01 + n10 + n11 <> total").count() == 0
    assert metrics.check_transitions(cells, targets).count() == 0
    got = {(r.threshold_kind, r.subset): r.incremental_rate for r in metrics.collateral_rates(cells).collect()}
    assert got[("evaluated_model", "nonincident_negative")] == 0.5 and got[("common", "nonincident_negative")] == 0.0
    assert got[("evaluated_model", "adjacent_negative")] == 0.0 and got[("common", "adjacent_negative")] == 1.0
    assert got[("evaluated_model", "adjacent_positive")] == 0.5 and got[("common", "adjacent_positive")] == 0.5


def test_classification_edge_cases(spark):
    one = spark.createDataFrame([(0.2, 0), (0.7, 0)], "p double, label int")
    row = metrics.classification(one, "p").first()
    assert row.auc is None and row.pr_auc is None and row.f1 == 0.0
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "p double, label int")
    row = metrics.classification(ties, "p", threshold=0.5).first()
    assert row.auc == pytest.approx(0.75) and row.pr_auc == pytest.approx(2 / 3) and row.f1 == pytest.approx(0.8)
    assert metrics.best_threshold(ties, "p").first().threshold == 0.5
    assert metrics.best_threshold(ties.limit(0), "p").first().threshold == 0.5


def test_target_metrics_empty_and_equal_threshold(spark):
    df = spark.createDataFrame([(0.4, 0.6), (0.6, 0.6), (0.1, 0.2)], "p double, q double")
    row = metrics.target_metrics(df, "p", "q", 0.6).first()
    assert (row.incremental_flips, row.clean_negative_targets) == (1, 2) and row.absolute_asr == pytest.approx(2 / 3)
    none = metrics.target_metrics(df.limit(0), "p", "q", 0.6).first()
    assert none.targets == 0 and none.absolute_asr is None and none.conditional_flip_rate is None


def test_single_run_has_no_deviation(spark):
    df = spark.createDataFrame([("m", 1.5)], "metric string, value double")
    assert metrics.run_summary(df).first().sample_std == 0.0


def test_contradictory_pair_is_marked(spark):
    df = spark.createDataFrame([("s", 1, 2, 0, 0.1, True), ("s", 2, 1, 1, 0.3, True), ("s", 1, 3, 0, 0.2, True)],
                               "scenario_id string, src int, dst int, label int, p double, supervised boolean")
    rows = metrics.pair_scores(df, ["p"]).collect()
    assert len(rows) == 1 and rows[0].contradictory and rows[0].p == pytest.approx(0.2)


def lane(points, **more):
    return {"centerline": [{"x": x, "y": y} for x, y in points], **more}


def test_lane_parser_is_fault_tolerant(spark):
    doc = {"lane_segments": {
        "1": lane([(0, 0), (10, 0)], id=1, left_neighbor_id=2, successors=[4, "x"]), "2": lane([(0, 4)], id=2),
        "3": lane([(0, 0), (1, 1)], id=3, lane_type="BIKE"), "4": lane([(0, 0), (0, 10), (0, 20)], is_intersection=True),
        "5": lane([("bad", 0), (1, 1)], id=5)}}
    maps = spark.createDataFrame([("s", json.dumps(doc)), ("broken", "{"), ("none", None)], "scenario_id string, map_json string")
    got = lanes.parse_lanes(maps)
    assert sorted(r.lane_id for r in got.collect()) == [1, 4]
    links = {(r.src, r.dst, r.kind) for r in lanes.lane_neighbors(got).collect()}
    assert links == {(1, 2, "lateral"), (1, 4, "topology")}
    headings = [r.heading for r in lanes.lane_points(got).where("lane_id = 4").orderBy("pt").collect()]
    assert headings == pytest.approx([1.5707963] * 3)


def test_nearest_lane_and_blocked_relation(spark):
    doc = {"lane_segments": {"1": lane([(x, 0) for x in range(0, 60, 5)]), "2": lane([(40, y) for y in range(-60, -15, 5)])}}
    maps = spark.createDataFrame([("s", json.dumps(doc))], "scenario_id string, map_json string")
    parsed = lanes.parse_lanes(maps)
    f = frames(spark, track("a", lambda t: 5, lambda t: 1), track("b", lambda t: 41, lambda t: -30), track("far", lambda t: 3000),
               track("lost", lambda t: 0, scenario="nomap"), track("lost2", lambda t: 9, scenario="nomap"))
    built = staged(tracks.build_nodes(f), "nodes")
    nodes = staged(lanes.nearest_lane(built, lanes.lane_points(parsed)), "nodes")
    got = {r.track_id: (r.lane_id, r.lane_distance) for r in nodes.collect()}
    assert got["a"] == (1, pytest.approx(1.0)) and got["b"] == (2, pytest.approx(1.0))
    assert got["far"] == (1, pytest.approx(2945.0)) and got["lost"] == (None, None)
    edges = {(r.src_track_id, r.dst_track_id): r for r in pairs.build_edges(nodes, lane_neighbors=lanes.lane_neighbors(parsed)).collect()}
    assert edges[("a", "b")].map_relation_type == 6 and edges[("a", "b")].hard_pruned and not edges[("a", "b")].supervision
    assert edges[("lost", "lost2")].map_relation_type == 0 and edges[("lost", "lost2")].map_candidate


def write_scenario(spark, root, name, rows):
    df = frames(spark, rows).drop("scenario_id").withColumns({
        "object_category": F.lit(3), "focal_track_id": F.lit("a"), "start_timestamp": F.lit(0.0)})
    df.toPandas().astype({"object_category": "int32", "timestep": "int32"}).to_parquet(f"{root}/{name}/scenario_{name}.parquet")


def test_folder_to_edges_round_trip(spark, tmp_path):
    for name in ("s1", "s2"):
        (tmp_path / "in" / name).mkdir(parents=True)
        write_scenario(spark, tmp_path / "in", name, track("a", lambda t: t) + track("b", lambda t: t + 5))
        (tmp_path / "in" / name / f"log_map_archive_{name}.json").write_text(json.dumps({"lane_segments": {"1": lane([(0, 0), (9, 0)])}}))
    root = str(tmp_path / "in")
    assert [r.scenario_id for r in tables.list_scenarios(spark, root).collect()] == ["s1", "s2"]
    assert tables.list_scenarios(spark, root, 1).count() == 1
    with pytest.raises(ValueError):
        tables.list_scenarios(spark, root, 0)
    f = tables.read_frames(spark, root)
    assert tables.check_one_file(f).count() == 0
    assert lanes.parse_lanes(tables.read_maps(spark, root)).count() == 2
    nodes = tracks.build_nodes(f)
    assert nodes.where("is_focal").count() == 2
    edges = pairs.build_edges(nodes, risk=RiskConfig())
    splits = spark.createDataFrame([("s1", "train"), ("s2", "val")], "scenario_id string, split string")
    out = str(tmp_path / "out")
    tables.write_graphs(nodes, edges, splits, out)
    n, e = tables.read_graphs(spark, out, "val")
    assert {r.scenario_id for r in e.collect()} == {"s2"} and n.count() == 2
    assert "PartitionFilters: [isnotnull(split" in e._jdf.queryExecution().executedPlan().toString()


def test_new_files_are_built_once(spark, tmp_path):
    def add(name):
        (tmp_path / "in" / name).mkdir(parents=True)
        write_scenario(spark, tmp_path / "in", name, track("a", lambda t: t))

    def run():
        build_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), lambda f: f.groupBy("scenario_id").count())
        return sorted((r.scenario_id, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add("s1")
    assert run() == [("s1", 110)]
    add("s2")
    assert run() == [("s1", 110), ("s2", 110)] and run() == [("s1", 110), ("s2", 110)]


def test_manifest_publication(spark, tmp_path):
    good = spark.createDataFrame([("a", "built")], "scenario_id string, status string")
    tables.write_manifest(good, good.groupBy().count(), str(tmp_path / "ok"))
    assert (tmp_path / "ok" / "manifest").exists()
    bad = tables.union_manifest(good, spark.createDataFrame([("b", "error", "boom")], "scenario_id string, status string, reason string"))
    with pytest.raises(RuntimeError):
        tables.write_manifest(bad, bad.groupBy().count(), str(tmp_path / "bad"))
    assert (tmp_path / "bad" / "manifest.failed").exists() and not (tmp_path / "bad" / "manifest").exists()
    assert tables.output_root("x", 3) == "x/partial_builds/limit_3"


def test_digests_of_real_files(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_text(name)
    actual = assets.file_digests(spark, str(tmp_path))
    assert {r.sha256 for r in actual.collect()} == {hashlib.sha256(n.encode()).hexdigest() for n in ("one", "two")}
    lines = assets.digest_lines(actual)
    parsed = assets.parse_digest_lines(lines)
    assert assets.check_digest_lines(parsed).count() == 0
    (tmp_path / "two").write_text("changed")
    frozen = spark.createDataFrame([(str(tmp_path / n), hashlib.sha256(n.encode()).hexdigest()) for n in ("one", "two", "three")], "path string, sha256 string")
    state = {r.path.rsplit("/", 1)[1]: r.state for r in assets.verify_assets(frozen, assets.file_digests(spark, str(tmp_path))).collect()}
    assert state == {"one": "ok", "two": "changed", "three": "missing"}
    rows = frozen.select(F.col("path").alias("graph_path"), F.col("sha256").alias("graph_sha256"))
    assert assets.verify_manifest_files(rows, assets.file_digests(spark, str(tmp_path))).count() == 2


def test_csv_metadata_keeps_ids_as_text(spark, tmp_path):
    header = ",".join(f.name for f in tables.GROUP_META.fields)
    (tmp_path / "m.csv").write_text(header + "\n007,c,r,k,f,derived,1.0,2.0,t1|t2\n")
    assert tables.read_group_metadata(spark, str(tmp_path / "m.csv")).first().scenario_id == "007"


def test_error_rows_do_not_stop_a_batch(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "scenario_id string, v int")
    got = {r.scenario_id: (r.status, r.reason) for r in tables.flag_errors(df, {"missing_value": F.col("v").isNull()}).collect()}
    assert got == {"a": ("built", None), "b": ("error", "missing_value")}


def test_staging_uses_one_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert staged(spark.range(5), "five").count() == 5
