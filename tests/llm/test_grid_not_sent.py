"""What op3 sends to all tasks; by the planner's estimate its exploded grid is as small as the fingerprints."""

from kinepair.llm import simhash
from kinepair.sources.staging import staged
from pyspark.sql import functions as F


def test_grid_of_fingerprints_is_not_sent(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k in names:
            spark.conf.unset(k)
        docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of "), F.col("id")).alias("text"))
        assert simhash.near_groups(docs).count() == 40
        # 540,000 grid points, of 160 kB as written fingerprints.
        prints = staged(spark.range(20_000).select(F.xxhash64("id").alias("fp")), "prints")
        found = simhash.links(prints)
        found.count()
        found.collect()
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
