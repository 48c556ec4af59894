"""What finished jobs leave on the driver."""

from kinepair.sources.staging import staged
from pyspark.sql import functions as F


def used_mb(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    return (runtime.totalMemory() - runtime.freeMemory()) >> 20


def test_staging_releases_the_garbage_of_finished_jobs(spark):
    small = spark.range(10).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    staged(small, "first")
    least = used_mb(spark)
    # Each stage of a job is sent in a block of 4 MB, which nothing holds afterwards.
    for k in range(40):
        small.where(F.col("id") > k).count()
    assert used_mb(spark) > least + 60
    staged(small, "second")
    assert used_mb(spark) < least + 40
