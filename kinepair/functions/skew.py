"""Joining rows to one row per key where a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one HOT_SHARE-th of all rows is hot; by counting there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def matched(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join of `left` with its row in `right`, which has one row per key and in `rows` the measured number of left rows.

    Rows of hot keys stay where they are: the fewer than HOT_SHARE hot rows of `right` are sent to all tasks. The rest
    is joined by a shuffle in which no key has more than its share. `left` has `total` rows at most and is read twice; stage it where that is dear.
    """
    hot = F.col(rows) * F.lit(HOT_SHARE) > F.lit(total)
    few, many = F.broadcast(right.where(hot)), right.where(~hot)
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(many, key))
