"""Connected components by alternating star contraction on written edge tables.

Defined results: edges with a null end or with two equal ends add nothing; repeated edges count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinepair.sources.staging import discard, measured_joins, staged_with


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large star) or smaller (small star) neighbours, itself included, to its smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b): the smallest node reachable.

    Rounds go on until a round changes nothing; each is written to the shared folder, so lost executors cost one round, and
    measured while it is written.
    """
    measured_joins(edges.sparkSession)
    sign = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sign"))
    first = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, found = staged_with(first, "links", *sign)
    while found["n"]:
        before, last = now, found
        now, found = staged_with(_star(_star(now, True), False), "stars", *sign)
        discard(before)
        if found == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
