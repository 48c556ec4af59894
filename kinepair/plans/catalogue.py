"""Registry of named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.plans.oracle_views import compose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Registers a query and, with `sql`, its check over the named views."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql, extra)
        return fn

    return register


def r6(value: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero; the small shift keeps exact halves off the rounding edge."""
    c = F.col(value) if isinstance(value, str) else value
    rounded = F.round(c.cast("double") + F.lit(1.2345e-9), digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def shown(df: DataFrame, exact: list[str], rounded: list[str] = (), whole: list[str] = ()) -> DataFrame:
    """Columns for comparison: as they are, rounded doubles, and whole numbers as bigint."""
    return df.select(*exact, *[F.col(c).cast("bigint").alias(c) for c in whole], *[r6(c).alias(c) for c in rounded])


def listed(exact: list[str], rounded: list[str] = (), whole: list[str] = ()) -> str:
    """The same column list in SQL."""
    from kinepair.plans.oracle_views import r

    return ", ".join([*exact, *[f"cast({c} as bigint) {c}" for c in whole], *[f"{r(c)} {c}" for c in rounded]])


def load() -> None:
    """Imports the modules that register queries."""
    from kinepair.plans import (  # noqa: F401
        queries_assets, queries_metrics, queries_pairs, queries_perturb, queries_selection, queries_splits, queries_tracks,
    )
