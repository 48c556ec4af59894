"""Cross-fit folds over split groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinepair.functions.ranks import running_before, running_totals
from kinepair.functions.scalar import hash_prefix, ratio
from kinepair.operators import audit

FOLD_COLUMNS = ("scenario_id", "split_group_id", "city", "source_split", "shadow_fold", "graph_sha256")


def fold_priority(seed: int, group: Column) -> Column:
    """Stable 64-bit order of a group."""
    return hash_prefix(F.concat(F.lit(f"{int(seed)}:"), group))


def city_priority(seed: int, city: Column, group: Column) -> Column:
    return hash_prefix(F.concat_ws("\0", F.lit(str(int(seed))), city, group))


def built_rows(manifest: DataFrame, split: str | None = None) -> DataFrame:
    """Rows with a finished graph, optionally of one split."""
    rows = manifest.where(F.col("status").isin("built", "exists") & F.col("graph_path").isNotNull())
    return rows if split is None else rows.where(F.col("split") == split)


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("city", "split_group_id").agg(F.count("*").alias("rows"))


def dealt_folds(manifest: DataFrame, num_folds: int = 3, seed: int = 20260810) -> DataFrame:
    """Train rows with `shadow_fold` for any number of groups.

    Groups of a city are dealt round by size and priority, which bounds the
    difference between folds by the largest group. The position of a group
    comes from running totals over sizes and a window per (city, size).
    """
    train = built_rows(manifest, "train")
    groups = group_sizes(train)
    classes = groups.groupBy("city", "rows").agg(F.count("*").alias("n"))
    before = running_totals(classes, ["city"], "rows", ["n"], descending=True)
    offset = before.select("city", "rows", (F.col("n_total") - F.col("n")).alias("_before"))
    # Leading digits of the priority: shards follow its order.
    shard = F.substring(F.sha2(F.concat(F.lit(f"{int(seed)}:"), "split_group_id"), 256), 1, 2)
    sharded = groups.withColumn("_shard", shard)
    sizes = sharded.groupBy("city", "rows", "_shard").agg(F.count("*").alias("_k"))
    earlier = W.partitionBy("city", "rows").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_k").over(earlier), F.lit(0))).drop("_k")
    rank = F.row_number().over(W.partitionBy("city", "rows", "_shard").orderBy(
        fold_priority(seed, F.col("split_group_id")), "split_group_id"))
    placed = sharded.withColumn("_rank", rank).join(sizes, ["city", "rows", "_shard"]).join(offset, ["city", "rows"])
    fold = F.pmod(F.col("_before") + F.col("_skip") + F.col("_rank") - 1, F.lit(num_folds)).cast("int")
    return _with_folds(train, placed.select("city", "split_group_id", fold.alias("shadow_fold")))


def _with_folds(train: DataFrame, chosen: DataFrame) -> DataFrame:
    return train.join(chosen, ["city", "split_group_id"]).withColumn("source_split", F.lit("train")).select(*FOLD_COLUMNS)


def fold_counts(folds: DataFrame) -> DataFrame:
    """Scenarios and groups per fold."""
    return folds.groupBy("shadow_fold").agg(F.count("*").alias("scenarios"), F.count_distinct("split_group_id").alias("groups"))


def city_fold_matrix(folds: DataFrame, num_folds: int = 3) -> DataFrame:
    return folds.groupBy("city").agg(*[F.count_if(F.col("shadow_fold") == f).alias(f"fold_{f}") for f in range(num_folds)])


def check_folds(folds: DataFrame, num_folds: int = 3) -> DataFrame:
    """Violations of a fold table."""
    c = F.col
    rules = {"train_only": c("source_split") == "train",
             "fold_in_range": audit.whole_number(c("shadow_fold")) & (c("shadow_fold") < num_folds),
             "digest_format": audit.hex_digest(c("graph_sha256"))}
    return audit.combine(
        audit.violations(folds, ["scenario_id"], rules), audit.unique(folds, ["scenario_id"]),
        audit.constant_within(folds, ["split_group_id"], "shadow_fold", "group_in_one_fold"))


def effective_manifest(manifest: DataFrame, folds: DataFrame, heldout: int) -> DataFrame:
    """Original train rows with the held-out fold as val and the rest as train."""
    fold = folds.select("scenario_id", "shadow_fold")
    return manifest.where("split = 'train'").join(fold, "scenario_id").withColumns({
        "original_split": F.lit("train"),
        "split": F.when(F.col("shadow_fold") == heldout, "val").otherwise("train")})


def check_effective(manifest: DataFrame, folds: DataFrame) -> DataFrame:
    """Exact cover of the train split and agreement of groups, cities and digests."""
    train = manifest.where("split = 'train'")
    other = folds.select("scenario_id", *[F.col(k).alias(f"_f_{k}") for k in ("split_group_id", "city", "graph_sha256")])
    both = train.join(other, "scenario_id")
    rules = {f"same_{k}": F.lower(F.col(k)) == F.lower(F.col(f"_f_{k}")) for k in ("split_group_id", "city", "graph_sha256")}
    return audit.combine(audit.same_set(train, folds, ["scenario_id"], "exact_cover"),
                         audit.unique(folds, ["scenario_id"]), audit.violations(both, ["scenario_id"], rules))


def inner_validation(rows: DataFrame, seed: int, fraction: float = 0.10) -> DataFrame:
    """Groups chosen per city for inner validation: (city, split_group_id).

    Groups of a city come in the order of a hash; one is taken while the rows
    before it and half its own stay below fraction * rows of the city. The first
    is always taken, the last never. Totals are running sums over shards
    of the order, so a city of any size is worked on by many tasks.
    """
    if not 0.0 < fraction < 0.5:
        raise ValueError("fraction must be within (0, 0.5)")
    groups = group_sizes(rows)
    totals = groups.groupBy("city").agg(F.sum("rows").alias("_all"), F.count("*").alias("_groups"))
    audit.require(audit.violations(totals, ["city"], {"two_groups": F.col("_groups") >= 2}))
    order = F.concat_ws(":", F.sha2(F.concat_ws(":", F.lit(str(int(seed))), "city", "split_group_id"), 256), "split_group_id")
    placed = running_before(groups.withColumn("_order", order), ["city"], "_order", F.col("rows"), "_ahead").join(totals, "city")
    wanted = (F.col("_ahead") == 0) | (2 * F.col("_ahead") + F.col("rows") < 2 * fraction * F.col("_all"))
    return placed.where(wanted & (F.col("_ahead") + F.col("rows") < F.col("_all"))).select("city", "split_group_id")


def fit_and_score(manifest: DataFrame, folds: DataFrame, heldout: int, inner_seed: int = 20260820,
                  fraction: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Fit rows (train, val) from the other folds and score rows of the held-out fold."""
    train = built_rows(manifest, "train").drop("split", "shadow_fold", "source_split").join(
        folds.select("scenario_id", "shadow_fold", "source_split"), "scenario_id")
    score = train.where(F.col("shadow_fold") == heldout).withColumn("split", F.lit("score"))
    rest = train.where(F.col("shadow_fold") != heldout)
    inner = inner_validation(rest, inner_seed + heldout, fraction).withColumn("_val", F.lit(True))
    fit = rest.join(inner, ["city", "split_group_id"], "left").withColumn(
        "split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")
    columns = [*FOLD_COLUMNS, "split"]
    return fit.select(*columns), score.select(*columns)


def check_fit_and_score(fit: DataFrame, score: DataFrame, folds: DataFrame) -> DataFrame:
    """Disjointness of scenarios and groups, and row-for-row cover of the outer folds."""
    rows = list(FOLD_COLUMNS)
    inner_train, inner_val = fit.where("split = 'train'"), fit.where("split = 'val'")
    return audit.combine(
        audit.disjoint(fit, score, ["scenario_id"], "scenario_fit_score"),
        audit.disjoint(fit, score, ["split_group_id"], "group_fit_score"),
        audit.disjoint(inner_train, inner_val, ["split_group_id"], "group_train_val"),
        audit.same_set(fit.select(*rows).unionByName(score.select(*rows)), folds, rows, "cover"))


def label_ratio(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Positive share of supervised edges per subset."""
    counts = manifest.select("scenario_id", "num_risk_positive_edges", "num_supervision_edges")
    return rows.select("scenario_id", "split").join(counts, "scenario_id").groupBy("split").agg(
        ratio(F.sum("num_risk_positive_edges"), F.sum("num_supervision_edges")).alias("label_ratio"))


def effective_fit(manifest: DataFrame, fit: DataFrame) -> DataFrame:
    """Manifest rows that take part in the fit, with their inner split."""
    inner = fit.select("scenario_id", F.col("split").alias("_split"), "shadow_fold")
    return manifest.join(inner, "scenario_id").withColumns(
        {"original_split": F.col("split"), "split": F.col("_split")}).drop("_split")


def compare_counts(recorded: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose recorded count differs from the recomputed one, missing rows included."""
    a = recorded.select(*keys, F.col(value).alias("recorded"))
    b = actual.select(*keys, F.col(value).alias("actual"))
    return a.join(b, keys, "full").where(~F.col("recorded").eqNullSafe(F.col("actual")))
