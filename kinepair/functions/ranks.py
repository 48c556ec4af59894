"""Running totals without a single-task window.

Rows are dealt into slices by ranges of the group and the order, once, and written with the number of their slice; totals of the earlier
slices are added to a running total within each slice. The ranges only shape the work, the totals are exact for any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinepair.sources.staging import staged

LEAST_SLICES = 16


def running_totals(df: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False,
                   slices: int | None = None) -> DataFrame:
    """Adds `<v>_total`: sum of v over this and all earlier rows of the group, and `<v>_all`, its group total.

    `df` has one row per (keys, order); the order column is a number. Without `slices` there are as many as shuffle
    partitions, LEAST_SLICES at least. `df` is evaluated once, for the written slices.
    """
    slices = slices or max(LEAST_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    direction = F.desc if descending else F.asc
    sliced = staged(df.repartitionByRange(slices, *keys, F.col(order)).withColumn("_slice", F.spark_partition_id()), "slices")
    sums = sliced.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(f"_{v}_sum") for v in values])
    # At most `slices` rows per group remain in this window.
    group = W.partitionBy(*[F.col(k) for k in keys]) if keys else W.partitionBy(F.lit(0))
    earlier = group.orderBy(direction("_slice")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_{v}_sum").over(earlier), F.lit(0)).alias(f"_{v}_before") for v in values],
        *[F.sum(f"_{v}_sum").over(group).alias(f"{v}_all") for v in values])
    on = [*keys, "_slice"]
    joined = sliced
    if keys:
        same = [F.col(f"_o_{k}").eqNullSafe(F.col(k)) for k in on]
        renamed = offsets.withColumnsRenamed({k: f"_o_{k}" for k in on})
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        joined = sliced.join(renamed, cond).drop(*[f"_o_{k}" for k in on])
    else:
        joined = sliced.join(offsets, on)
    within = W.partitionBy(*[F.col(k) for k in on]).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.withColumns({
        f"{v}_total": F.col(f"_{v}_before") + F.sum(v).over(within) for v in values
    }).drop("_slice", *[f"_{v}_before" for v in values])


def running_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str, prefix: int = 3) -> DataFrame:
    """Adds `out`: sum of `value` over the rows of the group with a smaller text `order`.

    Text is cut into shards by its first characters, which keeps the order;
    totals of the earlier shards are added to a running total within a shard,
    so a large group is ranked by many tasks. `order` is unique per group.
    """
    sharded = df.withColumns({"_shard": F.substring(order, 1, prefix), "_v": value})
    sums = sharded.groupBy(*keys, "_shard").agg(F.sum("_v").alias("_sum"))
    # One row per group and prefix.
    earlier = W.partitionBy(*keys).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_shard", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys, "_shard").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_v").over(within), F.lit(0))
    return sharded.withColumn("_local", local).join(offsets, [*keys, "_shard"]).withColumn(
        out, F.col("_before") + F.col("_local")).drop("_shard", "_v", "_local", "_before")
