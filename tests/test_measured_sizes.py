"""Sizes that only show after rows are exploded: what is sent to all tasks, and how many tasks make the rows of a view."""

from kinepair.plans import fixtures
from kinepair.sources.staging import tune
from pyspark.sql import functions as F


def test_exploded_side_is_not_sent(spark):
    # 200 rows that become a million: by the planner's estimate a few kilobytes, as a table of the tasks over eight megabytes.
    small = spark.range(200).withColumnRenamed("id", "k").groupBy("k").agg(F.max("k").alias("v"))
    points = small.select("k", F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("pt"))
    left = spark.range(1_000_000).select((F.col("id") % 200 + 0).alias("k"), "id").groupBy("k", "id").agg(F.max("id").alias("m")).where("id % 4999 = 0")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        joined = left.join(points, "k", "left")
        tune(spark)
        assert joined.count() == 201 * 5000
        found = left.join(points, "k", "left")
        found.collect()
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_views_are_made_by_more_tasks_as_they_grow(spark, sf_dir, monkeypatch):
    def tasks(df):
        return df.rdd.getNumPartitions()

    views = [fixtures.frames, fixtures.lane_points, fixtures.av_frames, fixtures.edge_scores]
    assert [v.__name__ for v in views if tasks(v(spark, sf_dir)) < 8] == []
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    assert [v.__name__ for v in views if tasks(v(spark, sf_dir)) <= 8] == []


def tuned(spark, run):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        tune(spark)
        return run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_side_that_grows_with_the_input_is_not_sent(spark):
    # About a megabyte when shuffled: a side of this kind came to the driver for each of the joins of a selection.
    def run():
        side = spark.range(200_000).selectExpr("concat('s', id) k").groupBy("k").agg(F.count("*").alias("n"))
        found = spark.range(400_000).selectExpr("concat('s', id % 200000) k", "id").join(side, "k")
        assert found.count() == 400_000
        found.collect()
        return found._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastExchange" not in tuned(spark, run)


def test_tasks_stay_small_whatever_the_shuffle_partitions(spark):
    # Some fifty megabytes when shuffled; four tasks before.
    def run():
        rows = spark.range(800_000).selectExpr("sha2(cast(id as string), 256) k").groupBy("k").count()
        return rows.rdd.getNumPartitions()

    assert tuned(spark, run) > 5
