"""Rules of finished work as tables of data, and order-free digests that bind tables to what is recorded of them.

A rule names its section, what is looked at, and what is expected. `broken` compiles a table of rules to columns over records (one row each, sections as
structs) and reports every rule that does not hold, with what was expected and what was found. An absent value breaks a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair import config as cfg


@dataclass(frozen=True)
class Rule:
    """`found` must equal `expected`, or `holds` must be true; all are SQL over a record's columns."""

    section: str
    name: str
    found: str
    expected: str
    holds: str | None = None

    def condition(self) -> Column:
        return F.coalesce(F.expr(self.holds or f"({self.found}) = ({self.expected})"), F.lit(False))


def broken(records: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, section, rule, expected, found) of every broken rule; one pass over the records."""
    cells = [F.when(~r.condition(), F.struct(F.lit(r.section).alias("section"), F.lit(r.name).alias("rule"), F.expr(f"cast(({r.expected}) as string)").alias("expected"),
                                             F.expr(f"cast(({r.found}) as string)").alias("found"))) for r in rules]
    return records.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*cells))).alias("_r")).select("key", "_r.*")


def _digest64(value: str) -> str:
    return f"coalesce({value}, '') rlike '^[0-9a-f]{{64}}$'"


# Sections, fields and settings that a finished training run records.
TRAINING = [
    Rule("config", "epochs", "config.epochs", "50"),
    Rule("config", "checkpoint_metric", "config.checkpoint_metric", "'val_loss'"),
    Rule("config", "require_strict_label", "config.require_strict_label", "true"),
    Rule("config", "evaluate_test", "config.evaluate_test", "false"),
    Rule("config", "uncapped", "coalesce(config.max_train_graphs, config.max_val_graphs)", "null", "config.max_train_graphs is null and config.max_val_graphs is null"),
    Rule("training_protocol", "objective", "training_protocol.objective", "'ordinary_binary_cross_entropy_symmetric_pair_labels'"),
    Rule("training_protocol", "initialization", "training_protocol.initialization", "'random'"),
    Rule("train_stats", "complete", "train_stats.graphs_considered", "split_graph_counts.train"),
    Rule("train_stats", "verified", "train_stats.graph_sha256_verified", "train_stats.graphs_considered"),
    Rule("val_stats", "complete", "val_stats.graphs_considered", "split_graph_counts.val"),
    Rule("val_stats", "unchanged", "val_stats.poisoned_graphs", "0"),
    Rule("val_pair_metrics", "threshold", "val_pair_metrics.threshold", "'between 0 and 1'", "val_pair_metrics.threshold > 0 and val_pair_metrics.threshold < 1"),
]

# Policies by which an evaluation may choose its pairs.
_FREE = (cfg.POLICY_SINGLE, cfg.POLICY_MIN_ENERGY, cfg.POLICY_SYMMETRIC)
_APART = (cfg.POLICY_MIN_ENERGY, cfg.POLICY_SYMMETRIC)


def _among(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


#: An evaluation chooses pairs without the model it judges, and its files are those that the training run names.
EVALUATION = [
    Rule("allocation", "model_independent", "evaluation_policy", f"'one of {', '.join(_FREE)}'", f"evaluation_policy in {_among(_FREE)}"),
    Rule("allocation", "apart_from_training", "evaluation_policy", f"'one of {', '.join(_APART)} after {cfg.POLICY_CROSSFIT}'",
         f"training_policy is distinct from '{cfg.POLICY_CROSSFIT}' or evaluation_policy in {_among(_APART)}"),
    Rule("clean_reference", "no_manifest", "reference_policy", "null", "reference_policy is null"),
    *[Rule("assets", f"{name}_digest", f"recorded_{name}_sha256", "'64 hexadecimal digits'", _digest64(f"recorded_{name}_sha256")) for name in ("checkpoint", "graph_manifest")],
    *[Rule("assets", f"{name}_bound", f"recorded_{name}_sha256", f"actual_{name}_sha256") for name in ("checkpoint", "graph_manifest")],
]

#: What is recorded beside a table of group metadata, against the table.
METADATA = [
    Rule("contract", "formal_split_eligible", "formal_split_eligible", "true"),
    Rule("contract", "metadata_contract_version", "metadata_contract_version", "4"),
    Rule("fingerprint", "segment_frames", "fingerprint_definition.segment_frames", "3"),
    Rule("fingerprint", "stride_frames", "fingerprint_definition.stride_frames", "1"),
    Rule("fingerprint", "absolute_time_grid", "fingerprint_definition.absolute_time_grid", "true"),
    Rule("fingerprint", "coverage", "fingerprint_definition.coverage", "'every_consecutive_three_frame_segment'"),
    Rule("output", "rows", "recorded_rows", "actual_rows"),
    Rule("output", "digest", "recorded_digest", "actual_digest"),
]

#: What is recorded beside a selection manifest, against the manifest.
MANIFEST = [
    Rule("table", "not_empty", "actual_rows", "'at least 1'", "actual_rows > 0"),
    Rule("table", "rows", "recorded_rows", "actual_rows"),
    Rule("table", "digest", "recorded_digest", "actual_digest"),
    Rule("label", "label_config_hash", "recorded_label_config_hash", "label_config_hash"),
    Rule("label", "one_label_config", "label_configs", "1"),
    Rule("sampling", "seed", "recorded_seed", "seed"),
    Rule("sampling", "one_seed", "seeds", "1"),
    Rule("sampling", "rate", "recorded_rate", "'between 0 and 1'", "recorded_rate > 0 and recorded_rate <= 1"),
    Rule("schedule", "windows", "windows", "'10, or 4 and 10 by a schedule'", f"windows = array(10) or (recorded_schedule = '{cfg.SCHEDULE_ID}' and size(array_except(windows, array(4, 10))) = 0)"),
    Rule("graphs", "graph_manifest_sha256", "recorded_graph_manifest_sha256", "'64 hexadecimal digits'", _digest64("recorded_graph_manifest_sha256")),
]


def table_digest(columns: list[str]) -> Column:
    """Aggregate: 126 bits, as text, of a table as a multiset of rows; order and partitions do not matter, every row and repeat does."""
    cells = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    word = lambda total: F.lpad(F.hex(F.pmod(total, F.expr("cast(9223372036854775808 as decimal(38,0))")).cast("bigint")), 16, "0")
    return F.lower(F.concat(word(F.coalesce(half(1), F.lit(0).cast("decimal(38,0)"))), word(F.coalesce(half(2), F.lit(0).cast("decimal(38,0)")))))


def with_digest(table: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """`actual_rows` and `actual_digest` of a table, per group if keys are given."""
    return table.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("actual_rows"), table_digest(columns).alias("actual_digest"))


def manifest_facts(manifest: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """What MANIFEST looks at, per group; joined with what is recorded of the group."""
    return manifest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("actual_rows"), table_digest(columns).alias("actual_digest"), F.min("label_config_hash").alias("label_config_hash"),
        F.count_distinct("label_config_hash").alias("label_configs"), F.min("seed").alias("seed"), F.count_distinct("seed").alias("seeds"),
        F.array_sort(F.collect_set(F.col("perturb_window").cast("int"))).alias("windows"))


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that two tables do not hold equally often: the columns, `in_first`, `in_second`. One shuffle of both; a swapped, doubled or lost row is named."""
    both = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*columns).agg(F.sum("_a").alias("in_first"), F.sum("_b").alias("in_second")).where("in_first <> in_second")
