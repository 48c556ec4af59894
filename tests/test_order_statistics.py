"""Exact order statistics, run lengths and running totals in one pass."""

from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinepair.functions.order import at_ranks, quantiles
from kinepair.functions.ranks import running_totals
from kinepair.operators.risk import run_lengths


@pytest.mark.parametrize("make", [
    lambda r: r.normal(0, 1, 5000), lambda r: 10.0 ** r.uniform(-300, 300, 4000) * r.choice([-1, 1], 4000), lambda r: np.repeat(3.25, 100),
    lambda r: np.nextafter(1.0, 2.0) + np.arange(9000) * 2.0 ** -52, lambda r: np.array([0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.0]), lambda r: r.integers(0, 3, 999).astype(float)])
def test_ranks_equal_sorting(spark, make):
    values = make(np.random.default_rng(3))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "x double")
    ranks = sorted({0, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1})
    want = np.sort(values)
    assert at_ranks(df, "x", ranks) == {k: want[k] for k in ranks}


def test_quantiles_of_many_distinct_values_equal_duckdb(spark, tmp_path):
    spark.range(10_000_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(1e9)).alias("x")).write.parquet(str(tmp_path / "x"))
    got = quantiles(spark.read.parquet(str(tmp_path / "x")), "x", [0.5, 0.95])
    want = duckdb.connect().execute(f"select quantile_cont(x, [0.5, 0.95]) from '{tmp_path}/x/*.parquet'").fetchone()[0]
    assert got == pytest.approx(want, rel=1e-15)


def test_quantiles_of_nothing_and_nan(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert quantiles(empty, "x", [0.5]) == [None]
    some = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert quantiles(some, "x", [0.0, 0.5])[1] == 2.0 and math.isnan(quantiles(some, "x", [1.0])[0])


def test_run_lengths_of_masks(spark):
    rng = np.random.default_rng(1)
    masks = [0, (1 << 60) - 1, 1, 1 << 59, 0b1110110, *(int(x) for x in rng.integers(0, 1 << 60, 40))]
    got = spark.createDataFrame([(m,) for m in masks] + [(None,)], "m long").select("m", run_lengths(F.col("m")).alias("n")).collect()
    for r in got:
        bits = [(r["m"] or 0) >> k & 1 for k in range(60)]
        want = [n if b else 0 for b, g in itertools.groupby(bits) for n in [len(list(g))] for _ in range(n)]
        assert r["n"] == want


def test_running_totals_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000).select((F.col("id") % 4).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100000)).alias("o"), F.lit(1).alias("n"))
    rows = df.groupBy("g", "o").agg(F.sum("n").alias("n")).mapInArrow(count, "g long, o long, n long")
    total = rows.count()
    before = seen.value
    out = running_totals(rows, ["g"], "o", ["n"], slices=5).toPandas()
    # The ranges are found on a sample of the shuffled rows, then each row goes through once.
    assert seen.value - before <= 2 * total
    for g, part in out.groupby("g"):
        part = part.sort_values("o")
        assert part["n_total"].tolist() == part["n"].cumsum().tolist() and (part["n_all"] == part["n"].sum()).all()
