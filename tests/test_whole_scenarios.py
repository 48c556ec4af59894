"""Scenarios that are not crowded: their vehicles are shuffled once, and neither copied nor shuffled again as pairs."""

import re

from kinepair.operators import pairs, perturb
from kinepair.sources.staging import by_scenario

PLACE = "scenario_id string, track_id string, cur_x double, cur_y double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df):
    return re.findall(r"hashpartitioning\((.*?), \d+\)", plan(df))


def test_vehicles_of_a_scenario_are_not_copied(spark):
    df = spark.createDataFrame([("s", "a", 900.0, 0.0), ("s", "b", 930.0, 0.0), ("s", "c", 990.0, 0.0), ("r", "a", 0.0, 0.0), (None, "a", 0.0, 0.0), (None, "b", 0.0, 0.0)], PLACE)
    found = pairs.radius_pairs(df, 60.0)
    assert "Generate" not in plan(found)
    assert sorted(tuple(r) for r in found.select("scenario_id", "a_track_id", "b_track_id").collect()) == [("s", "a", "b"), ("s", "b", "c")]
    # One crowded scenario beside it: the same pairs.
    more = df.unionByName(spark.createDataFrame([("crowd", f"k{i}", float(i % 7), 0.0) for i in range(9)], PLACE))
    both = pairs.radius_pairs(more, 60.0, crowd=4).select("scenario_id", "a_track_id", "b_track_id").collect()
    assert sorted(tuple(r) for r in both if r[0] != "crowd") == [("s", "a", "b"), ("s", "b", "c")] and len(both) == 2 + 36


def test_pairs_with_their_series_are_not_shuffled(spark):
    ids = spark.createDataFrame([("s", "a", "b"), ("s", "a", "c")], "scenario_id string, a_track_id string, b_track_id string")
    nodes = spark.createDataFrame([("s", t, float(k), 0.0) for k, t in enumerate("abc")], PLACE)
    moved = spark.createDataFrame([("s", 0.5, "a", 7.0, 0.0)], "scenario_id string, variant double, track_id string, cur_x double, cur_y double")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "-1")
        with by_scenario(spark):
            found = perturb.incident_pairs(ids, moved, nodes)
            rows = sorted((r.b_track_id, r.a_cur_x, r.b_cur_x) for r in found.collect())
            keys = shuffled_by(found)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows == [("b", 7.0, 1.0), ("c", 7.0, 2.0)]
    # After the ids only vehicles are shuffled, by scenario.
    assert sum(k.count(",") == 0 for k in keys) >= 5 and not any("variant" in k and k.count(",") == 2 for k in keys)
