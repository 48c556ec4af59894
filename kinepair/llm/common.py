"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than one HOT_SHARE-th of all rows count as hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_digest() -> Column:
    """With the id, what tells documents apart: rows that share both are one document."""
    return F.md5(whole_text().cast("binary"))


def order_of(*more: str) -> Column:
    """Order of documents by id, null last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *more)


class Shipped:
    """An object sent to the workers once, its class included."""

    def __init__(self, spark: SparkSession, value: Any):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self) -> Any:
        return pickle.loads(self.data.value)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Within it, jobs hand rows to Python in batches of about `size` bytes instead of by number of rows alone, which long rows make large on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table does not have yet, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_of_each(rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    """One `row` (a struct) of each key, that with the least hash; chosen before the shuffle, so a key may hold most of the rows."""
    return rows.groupBy(*keys).agg(F.min_by(row, F.xxhash64(row)).alias(row)).select(f"{row}.*")


def skew_lookup(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """`left` with the columns of its row in `right`, null where there is none.

    `right` has one row per key and in `rows` the number of left rows with that key; it
    must list every key with more than total / HOT_SHARE left rows, or none of its own
    columns matter for that key. Those hot keys are fewer than HOT_SHARE by counting, so they may
    be broadcast; all other keys are joined by a shuffle in which no key holds more
    than that share of the rows. `left` is read twice.
    """
    hot = F.col(rows) > F.lit(max(1, total // HOT_SHARE))
    few, many = F.broadcast(right.where(hot)), right.where(~hot)
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(many, key, "left"))
