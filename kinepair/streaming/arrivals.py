"""New scenario files as they arrive.

A scenario is one file, and a file always lands whole in one batch, so every
batch can be built on its own. The checkpoint remembers which files were done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.sources.tables import as_frames, scenario_folder, schema_groups


def build_new(spark: SparkSession, root: str, out: str, checkpoint: str, build: Callable[[DataFrame], DataFrame],
              files_per_batch: int = 10_000) -> None:
    """Builds all scenario files not yet built and writes one folder per batch under `out`.

    Repeating a batch after a failure overwrites its own folder, so nothing is
    counted twice.
    """
    files = f"{root}/*/scenario_*.parquet"
    groups = schema_groups(spark, files)
    if len(groups) != 1:
        raise ValueError("a stream needs files whose columns are of one kind each")
    frames = (spark.readStream.schema(groups[0][0]).option("maxFilesPerTrigger", files_per_batch)
              .parquet(files))
    frames = frames.select(scenario_folder().alias("scenario_id"), *as_frames(frames))

    def publish(batch: DataFrame, number: int) -> None:
        build(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    frames.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
