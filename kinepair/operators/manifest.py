"""Scenario manifest, corpus summary, and comparison with earlier builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the manifest's counts, and the edge column that each counts.
COUNTS = {
    "num_raw_edges": "raw_edge", "num_physical_possible_edges": "physical_possible",
    "num_message_passing_edges": "message_passing", "num_hard_pruned_edges": "hard_pruned",
    "num_task_candidate_edges": "task_candidate", "num_soft_task_excluded_edges": "soft_task_excluded",
    "num_label_computable_edges": "label_computable", "num_supervision_edges": "supervision",
    "num_interaction_candidate_edges": "task_candidate", "num_kinematic_candidate_edges": "kinematic_candidate",
    "num_map_candidate_edges": "map_candidate", "num_map_known_edges": "map_known",
    "num_map_unknown_edges": "map_unknown", "num_map_blocked_edges": "map_blocked",
    "num_same_lane_edges": "same_lane", "num_lateral_neighbor_lane_edges": "lateral_neighbor_lane",
    "num_connected_lane_edges": "connected_lane", "num_intersection_edges": "either_intersection",
}


def _rates(df: DataFrame) -> DataFrame:
    """Derived counts and rates; every denominator is at least 1."""
    c = F.col

    def rate(num: Column, den: str) -> Column:
        return num / F.greatest(c(den), F.lit(1)).cast("double")

    return df.withColumns({
        "num_proximity_negative_edges": c("num_label_computable_edges") - c("num_proximity_positive_edges"),
        "num_risk_negative_edges": c("num_label_computable_edges") - c("num_risk_positive_edges"),
        "num_filtered_proximity_positive_edges":
            c("num_proximity_positive_edges") - c("num_interaction_candidate_proximity_positive_edges"),
        "num_interaction_candidate_proximity_negative_edges":
            c("num_interaction_candidate_computable_edges") - c("num_interaction_candidate_proximity_positive_edges"),
        "physical_possible_retention_rate": rate(c("num_physical_possible_edges"), "num_raw_edges"),
        "task_candidate_retention_rate": rate(c("num_task_candidate_edges"), "num_raw_edges"),
        "interaction_candidate_retention_rate": rate(c("num_interaction_candidate_edges"), "num_edges"),
        "proximity_positive_rate": rate(c("num_proximity_positive_edges"), "num_label_computable_edges"),
        "risk_positive_rate": rate(c("num_risk_positive_edges"), "num_label_computable_edges"),
        "interaction_candidate_proximity_positive_rate": rate(
            c("num_interaction_candidate_proximity_positive_edges"), "num_interaction_candidate_computable_edges"),
        "physical_positive_recall": rate(
            c("num_proximity_positive_edges") - c("num_hard_pruned_proximity_positive_edges"), "num_proximity_positive_edges"),
        "task_positive_recall": rate(
            c("num_interaction_candidate_proximity_positive_edges"), "num_proximity_positive_edges"),
    }).withColumn("filtered_proximity_positive_rate",
                  rate(c("num_filtered_proximity_positive_edges"), "num_proximity_positive_edges"))


def scenario_counts(nodes: DataFrame, edges: DataFrame, lanes: DataFrame | None = None) -> DataFrame:
    """One row per scenario with edges: counts, rates and means.

    `num_lanes` counts all lanes of the map, `num_nearest_lanes` only those
    nearest to some node.
    """
    c = F.col
    positive = c("label_proximity") == 1
    usable = c("label_computable")
    table = edges.groupBy("scenario_id", "city").agg(
        F.count("*").alias("num_edges"),
        *[F.count_if(c(flag)).alias(name) for name, flag in COUNTS.items() if flag in edges.columns],
        F.count_if(positive).alias("num_proximity_positive_edges"),
        F.count_if(c("label_risk") == 1).alias("num_risk_positive_edges"),
        F.count_if(c("task_candidate") & usable).alias("num_interaction_candidate_computable_edges"),
        F.count_if(c("task_candidate") & usable & positive).alias("num_interaction_candidate_proximity_positive_edges"),
        F.count_if(c("hard_pruned") & usable & positive).alias("num_hard_pruned_proximity_positive_edges"),
        F.count_if(c("soft_task_excluded") & usable & positive).alias("num_soft_excluded_proximity_positive_edges"),
        F.avg("d_current").alias("mean_d_current"),
        F.coalesce(F.avg(F.when(usable, c("future_min_distance"))), F.lit(0.0)).alias("mean_future_min_distance"))
    near = [F.count_distinct("lane_id").alias("num_nearest_lanes")] if "lane_id" in nodes.columns else []
    table = table.join(nodes.groupBy("scenario_id").agg(F.count("*").alias("num_nodes"), *near), "scenario_id")
    if lanes is not None:
        table = table.join(lanes.groupBy("scenario_id").agg(F.count_distinct("lane_id").alias("num_lanes")),
                           "scenario_id", "left").fillna(0, subset=["num_lanes"])
    return _rates(table)


def scenario_status(scenarios: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`built`, or `skipped` with the reason `fewer_than_two_nodes` or `no_eligible_edges`."""
    n = nodes.groupBy("scenario_id").agg(F.count("*").alias("num_nodes"))
    e = edges.groupBy("scenario_id").agg(F.count("*").alias("num_edges"))
    df = scenarios.select("scenario_id").distinct().join(n, "scenario_id", "left").join(e, "scenario_id", "left").fillna(0)
    reason = F.when(F.col("num_nodes") < 2, "fewer_than_two_nodes").when(F.col("num_edges") == 0, "no_eligible_edges")
    return df.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "built").otherwise("skipped"))


def corpus_summary(manifest: DataFrame) -> DataFrame:
    """Sums and rates over all built scenarios, per city, and per split if present, in one pass.

    `scope` names what a row stands for, so a missing city is not taken for the total.
    """
    built = manifest.where(F.col("status").isin("built", "exists")) if "status" in manifest.columns else manifest
    sums = [c for c in manifest.columns if c.startswith("num_") and c not in (
        "num_proximity_negative_edges", "num_risk_negative_edges", "num_filtered_proximity_positive_edges",
        "num_interaction_candidate_proximity_negative_edges", "num_lanes", "num_nearest_lanes")]
    by = [c for c in ("city", "split") if c in manifest.columns]
    grouped = built.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(
        F.coalesce(*[F.when(F.grouping(b) == 0, F.lit(b)) for b in by], F.lit("total")).alias("scope"),
        F.count("*").alias("num_graphs"), *[F.sum(c).alias(c) for c in sums])
    return _rates(grouped)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of each column: (kind, value, n)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(kinds.alias("_k")).groupBy("_k.kind", "_k.value").agg(F.count("*").alias("n"))


def pending(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs without an output of the same source, configuration and, where it is recorded, schema version."""
    keys = [k for k in ("schema_version",) if k in inputs.columns and k in outputs.columns]
    return inputs.join(outputs, ["scenario_id", "config_sha256", "source_sha256", *keys], "left_anti")


def incompatible(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Existing outputs that were made from other sources, another configuration or another schema."""
    keys = [k for k in ("schema_version", "config_sha256", "source_sha256") if k in inputs.columns and k in outputs.columns]
    old = outputs.select("scenario_id", *[F.col(k).alias(f"built_{k}") for k in keys])
    joined = inputs.join(old, "scenario_id")
    differs = F.lit(False)
    for k in keys:
        differs = differs | ~F.col(k).eqNullSafe(F.col(f"built_{k}"))
    return joined.where(differs)


def usable_rows(manifest: DataFrame) -> DataFrame:
    """Manifest rows with a finished graph in a known split."""
    return manifest.where(F.col("status").isin("built", "exists") & F.col("graph_path").isNotNull()
                          & F.col("split").isin("train", "val", "test"))


def check_manifest(manifest: DataFrame) -> DataFrame:
    """Unique ids, known split and well-formed digest of the usable rows."""
    from kinepair.operators import audit

    rows = manifest.where(F.col("status").isin("built", "exists") & F.col("graph_path").isNotNull())
    return audit.combine(
        audit.violations(rows, ["scenario_id"], {
            "split": F.col("split").isin("train", "val", "test"), "digest": audit.hex_digest(F.col("graph_sha256"))}),
        audit.unique(rows, ["scenario_id"]))
