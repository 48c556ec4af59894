"""Cleaning, quality and features of tracks, against numpy where useful."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import frames, track
from kinepair.operators import pairs, tracks

NAN = float("nan")


def test_invalid_and_duplicate_frames(spark):
    rows = track("a", lambda t: t)
    rows[3] = (*rows[3][:6], NAN, *rows[3][7:])
    rows[4] = (*rows[4][:6], float("inf"), *rows[4][7:])
    rows += [(*rows[7][:6], 100.0, *rows[7][7:])] * 3  # repeated timestep: the largest position is kept
    row = tracks.gather_tracks(frames(spark, rows)).first()
    seen = {p.t: p.x for p in row.obs}
    assert 3 not in seen and 4 not in seen and len(seen) == 48
    assert seen[7] == 100.0 and row.num_duplicate_frames == 3


def test_gap_fill_matches_numpy(spark):
    steps = [t for t in range(110) if t not in (0, 1, 10, 11, 12, 48, 49)]
    f = frames(spark, track("a", lambda t: t * t, steps=steps))
    path = tracks.fill_gaps(tracks.unwrap_headings(tracks.gather_tracks(f))).first().path
    known = [t for t in steps if t < 50]
    want = np.interp(range(50), known, [t * t for t in known])
    assert [p.x for p in path] == pytest.approx(list(want))
    assert [p.t for p in path] == list(range(50))
    assert sum(p.ok for p in path) == len(known)


def test_empty_observation_gives_zeros(spark):
    f = frames(spark, track("a", lambda t: t, steps=range(50, 110)))
    path = tracks.fill_gaps(tracks.unwrap_headings(tracks.gather_tracks(f))).first().path
    assert len(path) == 50 and all(p.x == 0 and not p.ok for p in path)


def test_turning_heading_is_unwrapped(spark):
    def turn(t):
        return math.atan2(math.sin(0.3 * t), math.cos(0.3 * t))

    steps = [t for t in range(110) if t % 7 != 3]
    t = tracks.unwrap_headings(tracks.gather_tracks(frames(spark, track("a", lambda t: t, heading=turn, steps=steps))))
    known = [s for s in steps if s < 50]
    got = [p.u for p in t.first().obs]
    assert got == pytest.approx(list(np.unwrap([turn(s) for s in known])))
    path = tracks.fill_gaps(t).first().path
    assert [math.cos(p.h) for p in path[:46]] == pytest.approx([math.cos(0.3 * s) for s in range(46)], abs=1e-9)


def reasons(spark, *rows):
    q = tracks.track_quality(tracks.prepare_tracks(frames(spark, *rows)))
    return {r.track_id: r.skip_reason for r in q.select("track_id", "skip_reason").collect()}


def test_quality_cascade(spark):
    def jumpy(t):
        return t + (100 if t in (10, 20, 30) else 0)

    got = reasons(
        spark, track("good", lambda t: t), track("walker", lambda t: t, kind="pedestrian"), track("short", lambda t: t, steps=range(10, 49)),
        track("early", lambda t: t, steps=range(0, 45)), track("jumps", jumpy), track("fast", lambda t: t, vx=50.0))
    assert got == {"good": None, "walker": "non_vehicle", "short": "obs_too_short", "early": "no_last_obs", "jumps": "pos_jumps",
                   "fast": "speed_extreme"}


def test_acceleration_uses_real_gaps(spark):
    rows = [(*r[:8], 5.0 * r[4], *r[9:]) for r in track("a", lambda t: t, steps=[0, 1, 5, *range(8, 110)])]
    acc = tracks.prepare_tracks(frames(spark, rows)).first().acc
    assert all(a.norm == pytest.approx(50.0) for a in acc)


def test_node_vector_is_finite_and_wide(spark):
    n = tracks.node_features(tracks.build_nodes(frames(spark, track("a", lambda t: t, vx=10.0)))).first()
    assert len(n.features) == 358 and all(math.isfinite(v) for v in n.features)
    assert n.features[49] == 0.0 and n.speed_current == 10.0


def test_pair_residual_is_zero_for_constant_velocity_and_symmetric(spark):
    f = frames(spark, track("a", lambda t: 0.1 * t, vx=1.0), track("b", lambda t: 10 + 0.2 * t, vx=2.0))
    p = pairs.build_pairs(tracks.build_nodes(f)).first()
    assert p.relative_motion_window_valid == 1.0
    assert p.relative_residual_los_dct1 == pytest.approx(0.0, abs=1e-9)
    assert p.terminal_relative_velocity_residual_los == pytest.approx(0.0, abs=1e-9)
    edges = pairs.directed_edges(pairs.build_pairs(tracks.build_nodes(f))).collect()
    assert len(edges) == 2 and edges[0].d_mean_obs == edges[1].d_mean_obs


def test_missing_window_frame_gives_zero_residual(spark):
    f = frames(spark, track("a", lambda t: t, steps=[t for t in range(110) if t != 42]), track("b", lambda t: 10 + t * t * 0.01))
    p = pairs.build_pairs(tracks.build_nodes(f)).first()
    assert p.relative_motion_window_valid == 0.0 and p.relative_residual_los_dct2 == 0.0


@pytest.mark.parametrize("crowd", [512, 3])
def test_radius_join_equals_brute_force(spark, crowd):
    rng = np.random.default_rng(5)
    pts = [("s%d" % (i % 2), f"k{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-200, 200, (150, 2)))]
    df = spark.createDataFrame(pts, "scenario_id string, track_id string, cur_x double, cur_y double")
    got = {(r.a_track_id, r.b_track_id) for r in pairs.radius_pairs(df, 60.0, crowd=crowd).collect()}
    want = {(a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 60}
    assert got == want


def test_numbering_is_dense_in_order(spark):
    ids = [("s", f"t{i}") for i in range(37)] + [("r", "x")]
    n = pairs.number_nodes(spark.createDataFrame(ids, "scenario_id string, track_id string"))
    got = [r.track_id for r in n.where("scenario_id = 's'").orderBy("node_id").collect()]
    assert got == sorted(i for s, i in ids if s == "s")
    assert n.where("scenario_id = 's'").agg(F.min("node_id"), F.max("node_id")).first() == (0, 36)


def test_series_are_sorted_natively(spark):
    # `array_sort` calls a lambda for each comparison.
    plan = tracks.track_quality(tracks.prepare_tracks(frames(spark, track("a", lambda t: t))))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
