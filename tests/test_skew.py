"""Hot keys, crowded places and far-off vehicles: same results, balanced tasks."""

from __future__ import annotations

import math
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinepair.functions.skew import matched
from kinepair.operators import audit, lanes, pairs, splits
from kinepair.sources.staging import staged

PLACE = "scenario_id string, track_id string, cur_x double, cur_y double"


def plan(df):
    return df._jdf.queryExecution().toString()


def task_rows(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def roots_by_hand(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, k in links:
        a, b = root(("s", s)), root(("k", k))
        up[max(a, b)] = min(a, b)
    groups = {}
    for s, _ in links:
        groups.setdefault(root(("s", s)), set()).add(s)
    return {s: min(g) for g in groups.values() for s in g}


def test_components_with_a_token_on_a_third_of_all_recordings(spark):
    rng = np.random.default_rng(4)
    names = [f"r{i:05d}" for i in range(6000)]
    links = [(n, "hub") for n in names[::3]] + [(n, f"t{i // 3 if i % 3 else i}") for i, n in enumerate(names)]
    # A long chain and a few random groups beside the hub.
    links += [(f"c{i:03d}", f"chain{i + d}") for i in range(200) for d in (0, 1)] + [(f"g{i}", f"z{rng.integers(40)}") for i in range(200)]
    df = spark.createDataFrame(links, "scenario_id string, key string").repartition(8)
    got = {r["scenario_id"]: r["root"] for r in splits.connect(df).collect()}
    assert got == roots_by_hand(links)


def test_rows_of_hot_keys_stay_where_they_are(spark):
    rows = staged(spark.range(0, 80_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000).alias("key"), "id"), "hot")
    per_key = rows.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    joined = matched(rows, per_key, "key", "n", 80_000)
    assert joined.count() == 80_000 and joined.where("low > id").count() == 0
    hot = task_rows(joined.where("key = -1"))
    assert sum(hot) == 26_667 and hot[-1] <= 2 * statistics.median(hot)


def brute_lane(points, x, y):
    return min((math.hypot(px - x, py - y), lane, pt) for lane, pt, px, py in points)


def test_nearest_lane_at_any_distance(spark):
    rng = np.random.default_rng(2)
    maps = {"s": [(int(k), i, float(40 * k + i * 3), float(rng.uniform(-30, 30))) for k in range(5) for i in range(12)],
            "t": [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-400, 400, (60, 2)))]}
    places = [("s", f"v{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 500, (60, 2)))]
    places += [("t", f"v{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-900, 900, (80, 2)))]
    places += [("s", "far", 5000.0, -3000.0), ("t", "edge", -50.0, 100.0), ("t", "farther", -4.0e6, 9.0e6), ("s", "nan", float("nan"), 0.0), ("none", "v", 1.0, 1.0)]
    pts = spark.createDataFrame([(s, *p, 0.5, True) for s, v in maps.items() for p in v], "scenario_id string, lane_id long, pt int, x double, y double, heading double, is_intersection boolean")
    found = lanes.nearest_lane(spark.createDataFrame(places, PLACE), pts)
    got = {(r.scenario_id, r.track_id): (r.lane_distance, r.lane_id) for r in found.collect()}
    assert len(got) == len(places)
    for s, name, x, y in places:
        if s == "none" or name == "nan":
            assert got[s, name] == (None, None)
        else:
            distance, lane, _ = brute_lane(maps[s], x, y)
            assert got[s, name][1] == lane and abs(got[s, name][0] - distance) <= 1e-9 * max(1, distance)
    joins = re.findall(r"(?:Sort|Shuffled?|Broadcast)\w*Join (?:\[(.*?)\])", plan(found))
    assert joins and not any(re.fullmatch(r"scenario_id#\d+", j) for j in joins)


@pytest.mark.parametrize("crowd", [16, 100])
def test_crowded_place_beside_sparse_scenes(spark, crowd):
    rng = np.random.default_rng(8)
    points = [("crowd", f"k{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(1000, 25, (700, 2)))]
    points += [("crowd", f"same{i:03d}", 990.0, 990.0) for i in range(150)]
    points += [(f"s{i % 30}", f"v{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (400, 2)))]
    df = spark.createDataFrame(points, PLACE)
    got = sorted((r.scenario_id, r.a_track_id, r.b_track_id) for r in pairs.radius_pairs(df, 60.0, crowd=crowd).select("scenario_id", "a_track_id", "b_track_id").collect())
    want = sorted((a[0], *sorted((a[1], b[1]))) for i, a in enumerate(points) for b in points[:i] if a[0] == b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 60)
    assert got == want


def test_leaves_hold_no_more_than_a_crowd(spark):
    rng = np.random.default_rng(9)
    # Default arguments: a third of all vehicles within 60 metres of one point.
    df = spark.createDataFrame([("c", f"k{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-42, 42, (20_000, 2)))]
                               + [(f"s{i}", f"k{i}", float(i % 97), 0.0) for i in range(40_000)], PLACE)
    leaves = pairs.crowded_cells(df.select("scenario_id", F.col("cur_x").alias("x"), F.col("cur_y").alias("y")), 120.0).toPandas()
    assert set(leaves["scenario_id"]) == {"c"}
    here = df.where("scenario_id = 'c'").toPandas()
    sizes = []
    for r in leaves.to_dict("records"):
        side = 120.0 / 2 ** r["_depth"]
        sizes.append(int(((here.cur_x // side == r["_lx"]) & (here.cur_y // side == r["_ly"])).sum()) / r["_parts"])
    assert sum(size * r for size, r in zip(sizes, leaves["_parts"])) == 20_000
    assert max(sizes) <= pairs.CROWD and len(leaves) > 20_000 / pairs.CROWD


def test_recordings_without_finite_positions_are_refused(spark):
    def av(scenario, xs, start=1.5e18):
        return [(scenario, "c", "AV", "vehicle", t, True, x, 0.0, float(start) if start is not None else None) for t, x in enumerate(xs)]

    rows = av("good", [1.0, 2.0, 3.0, 4.0]) + av("none", [None] * 4) + av("void", [None] * 4) + av("nan", [1.0, float("nan"), 3.0, 4.0, 5.0, 6.0]) + av("timeless", [1.0] * 4, None)
    frames = spark.createDataFrame(rows, "scenario_id string, city string, track_id string, object_type string, timestep int, observed boolean, position_x double, position_y double, start_timestamp double")
    tokens = splits.recorder_tokens(frames)
    assert {r.scenario_id for r in tokens.collect()} == {"good"}
    meta = frames.select("scenario_id").distinct()
    assert {r.key for r in splits.check_tokens(meta, tokens).collect()} == {"none", "void", "nan", "timeless"}
    with pytest.raises(audit.ConstraintError):
        audit.require(splits.check_tokens(meta, tokens))
