"""Rule tables and order-free digests."""

from __future__ import annotations

import pytest

from kinepair import config as cfg
from kinepair.operators import rules

ROW = "g string, a int, b string"


def test_digest_sees_rows_and_repeats_but_not_order(spark):
    rows = [("x", 1, "p"), ("x", None, "q"), ("x", 1, "p"), ("x", 3, None)]
    of = lambda r: rules.with_digest(spark.createDataFrame(r, ROW), ["a", "b"]).first()["actual_digest"]
    same = of(rows)
    assert len(same) == 32 and of(rows[::-1]) == same
    for other in (rows[1:], rows + rows[:1], [("x", 1, "q"), ("x", None, "p"), *rows[2:]], [("x", 3, "p"), *rows[1:3], ("x", 1, None)]):
        assert of(other) != same
    assert rules.with_digest(spark.createDataFrame([], ROW), ["a"]).first()["actual_rows"] == 0


GOOD = {"evaluation_policy": cfg.POLICY_SYMMETRIC, "training_policy": cfg.POLICY_CROSSFIT, "reference_policy": None, "recorded_checkpoint_sha256": "a" * 64, "actual_checkpoint_sha256": "a" * 64,
        "recorded_graph_manifest_sha256": "b" * 64, "actual_graph_manifest_sha256": "b" * 64}


@pytest.mark.parametrize("change, wrong", [
    ({}, []), ({"evaluation_policy": cfg.POLICY_CROSSFIT}, ["apart_from_training", "model_independent"]), ({"evaluation_policy": cfg.POLICY_SINGLE}, ["apart_from_training"]),
    ({"evaluation_policy": cfg.POLICY_SINGLE, "training_policy": None}, []), ({"reference_policy": "x"}, ["no_manifest"]), ({"actual_checkpoint_sha256": "c" * 64}, ["checkpoint_bound"]),
    ({"recorded_graph_manifest_sha256": None}, ["graph_manifest_bound", "graph_manifest_digest"]), ({"recorded_checkpoint_sha256": "A" * 64}, ["checkpoint_bound", "checkpoint_digest"])])
def test_evaluation_rules(spark, change, wrong):
    record = {"run": "r", **GOOD, **change}
    df = spark.createDataFrame([tuple(record.values())], ", ".join(f"{k} string" for k in record))
    assert sorted(r["rule"] for r in rules.broken(df, rules.EVALUATION, "run").collect()) == wrong


def test_manifest_rules(spark):
    manifest = spark.createDataFrame([("m", f"s{i}", "h", 7, 10) for i in range(5)], "name string, scenario_id string, label_config_hash string, seed int, perturb_window int")
    facts = rules.manifest_facts(manifest, ["scenario_id"], ["name"])
    found = facts.first()
    record = {"name": "m", "recorded_rows": 5, "recorded_digest": found["actual_digest"], "recorded_label_config_hash": "h", "recorded_seed": 7, "recorded_rate": 0.05, "recorded_schedule": None,
              "recorded_graph_manifest_sha256": "d" * 64}
    schema = "name string, recorded_rows long, recorded_digest string, recorded_label_config_hash string, recorded_seed int, recorded_rate double, recorded_schedule string, recorded_graph_manifest_sha256 string"

    def judged(table, **change):
        recorded = spark.createDataFrame([tuple({**record, **change}.values())], schema)
        joined = recorded.join(rules.manifest_facts(table, ["scenario_id"], ["name"]), "name", "left")
        return sorted(r["rule"] for r in rules.broken(joined, rules.MANIFEST, "name").collect())

    assert judged(manifest) == []
    assert judged(manifest, recorded_rows=4) == ["rows"] and judged(manifest, recorded_seed=8) == ["seed"] and judged(manifest, recorded_rate=0.0) == ["rate"]
    assert judged(manifest, recorded_label_config_hash="x") == ["label_config_hash"] and judged(manifest, recorded_graph_manifest_sha256="?") == ["graph_manifest_sha256"]
    assert judged(manifest.withColumn("scenario_id", manifest.scenario_id.substr(1, 1))) == ["digest"]
    assert "not_empty" in judged(manifest.limit(0))
    four = manifest.withColumn("perturb_window", manifest.seed - 3)
    assert judged(four) == ["windows"] and judged(four, recorded_schedule=cfg.SCHEDULE_ID) == []


def test_difference_of_multisets(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("x", 1, "p"), ("y", 2, None)], ROW)
    b = spark.createDataFrame([("x", 1, "p"), ("y", 2, None), ("y", 2, None), ("z", 0, "q")], ROW)
    assert sorted(map(tuple, rules.multiset_difference(a, b, ["g", "a", "b"]).collect())) == [("x", 1, "p", 2, 1), ("y", 2, None, 1, 2), ("z", 0, "q", 0, 1)]
