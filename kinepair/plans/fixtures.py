"""Views derived from the given tables; see FIXTURES.md, part B."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.sources.staging import tune


#: Rows that a task of a view makes, about.
TASK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str, fold: int) -> DataFrame:
    """Spreads a small base table before each row becomes `fold` of them: over the cores at least, and over more tasks as it grows.

    Adaptive execution sees only the bytes before that, and would leave all in one task. A `distinct` goes after it, or its own exchange is kept instead.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * fold // TASK_ROWS))
    return df.repartition(tasks, key)


def _grid(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 110)
    return cust.withColumn("timestep", _grid(110)).selectExpr(
        "c_custkey k", "cast(floor(c_custkey/12) as bigint) sc", "c_acctbal b", "timestep",
        "cast(timestep as double)*cast(0.1 as double) tt",
    ).where("not (k % 19 = 0 and timestep between 10 and 35) and ((k*31 + timestep*17) % 97) <> 0").selectExpr(
        "*", "concat('s', cast(sc as string)) scenario_id", "concat('city', cast(sc % 5 as string)) city",
        "concat('t', cast(k as string)) track_id",
        "case when k % 11 = 0 then 'pedestrian' when k % 13 = 0 then 'bus' else 'vehicle' end object_type",
        "cast((k*37) % 101 - 50 as double) + b*cast(0.001 as double) x0",
        "cast(k % 4 as double)*cast(3.5 as double) y0",
        "case when k % 4 >= 2 then cast(-1 as double) else cast(1 as double) end dir",
        "cast((k*13) % 23 as double)*cast(0.6 as double) v",
        "cast((k*7) % 9 - 4 as double)*cast(0.25 as double) a",
    ).selectExpr(
        "scenario_id", "city", "track_id", "k", "object_type", "timestep", "timestep < 50 observed",
        "x0 + dir*(v*tt + cast(0.5 as double)*a*tt*tt)"
        " + case when k % 29 = 0 and timestep >= 20 then cast(60 as double) else cast(0 as double) end position_x",
        "y0 position_y", "dir*(v + a*tt) velocity_x", "cast(0 as double) velocity_y",
        "case when dir < 0 then cast(3.141592653589793 as double) else cast(0 as double) end heading")


def lane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    scen = _spread(table(spark, sf_dir, "customer").selectExpr("cast(floor(c_custkey/12) as bigint) sc"), "sc", 4 * 41 // 12).distinct()
    return scen.withColumn("l", _grid(4)).withColumn("pt", _grid(41)).selectExpr(
        "concat('s', cast(sc as string)) scenario_id", "sc*10+l lane_id", "l", "l % 4 = 3 is_intersection", "pt",
        "cast(pt*10-200 as double) x", "cast(l as double)*cast(3.5 as double) y",
        "case when l > 0 then sc*10+l-1 end left_neighbor_id",
        "case when l < 3 then sc*10+l+1 end right_neighbor_id")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = _spread(table(spark, sf_dir, "customer").selectExpr("cast(floor(c_custkey/10) as bigint) r"), "r", 3 * 110 // 10).distinct()
    return rec.withColumn("w", _grid(3)).where("w <= r % 3").selectExpr(
        "r", "w", "w * case when r % 7 = 0 then 200 else 40 end sh",
        "concat('a', cast(r as string), '_', cast(w as string)) scenario_id",
        "concat('city', cast(r % 5 as string)) city")


def av_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).withColumn("timestep", _grid(110)).selectExpr(
        "scenario_id", "city", "r", "w", "'AV' track_id", "timestep",
        "cast(r as double)*cast(1.7 as double) + cast(0.83 as double)*cast(sh+timestep as double) position_x",
        "cast(((sh+timestep)*(sh+timestep)) % 17 as double)*cast(0.1 as double) position_y",
        "(r*1000+sh)*100000000 start_timestamp")


def group_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).selectExpr(
        "scenario_id", "city",
        "case when r % 5 = 0 then concat('rec', cast(r as string))"
        " else concat('rec', cast(r as string), '_', cast(w as string)) end recording_group_id_v2",
        "case when r % 10 in (0,5) then sha1(concat('dup', cast(cast(floor(r/10) as bigint) as string)))"
        " else sha1(scenario_id) end content_sha1",
        "sha1(concat('f', scenario_id)) focal_trajectory_hash_0p1m", "'derived' recording_group_source_v2",
        "(r*1000+sh)*100000000 start_timestamp", "(r*1000+sh)*100000000 + 10900000000 end_timestamp")


def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").selectExpr("c_custkey k", "cast(floor(c_custkey/12) as bigint) sc")
    cust = _spread(cust, "sc", 11)
    a, b = cust.alias("a"), cust.alias("b")
    pairs = a.join(b, F.expr("a.sc = b.sc and a.k <> b.k")).selectExpr(
        "a.sc sc", "a.k i", "b.k j", "case when (a.k+b.k) % 7 = 0 then 1 else 0 end y")
    return pairs.selectExpr(
        "*", "cast(((i*7919+j*104729) % 1000) as double)*cast(0.0007 as double)"
        " + cast(0.3 as double)*cast(y as double) pc",
    ).selectExpr(
        "concat('s', cast(sc as string)) scenario_id", "concat('city', cast(sc % 5 as string)) city",
        "i src", "j dst", "y label", "pc clean_probability",
        "case when (i+j) % 3 = 0 then least(cast(1 as double), pc + cast(0.25 as double)) else pc end"
        " perturbed_probability",
        "(i+j) % 11 <> 0 supervised")
