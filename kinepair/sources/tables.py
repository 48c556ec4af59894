"""Readers and writers with fixed schemas."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinepair.sources.staging import staged

FRAMES = T.StructType([
    T.StructField("track_id", T.StringType()), T.StructField("object_type", T.StringType()),
    T.StructField("object_category", T.IntegerType()), T.StructField("timestep", T.IntegerType()),
    T.StructField("observed", T.BooleanType()), T.StructField("position_x", T.DoubleType()),
    T.StructField("position_y", T.DoubleType()), T.StructField("velocity_x", T.DoubleType()),
    T.StructField("velocity_y", T.DoubleType()), T.StructField("heading", T.DoubleType()),
    T.StructField("focal_track_id", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("start_timestamp", T.DoubleType())])

GROUP_META = T.StructType([
    T.StructField("scenario_id", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("recording_group_id_v2", T.StringType()), T.StructField("content_sha1", T.StringType()),
    T.StructField("focal_trajectory_hash_0p1m", T.StringType()), T.StructField("recording_group_source_v2", T.StringType()),
    T.StructField("start_timestamp", T.DoubleType()), T.StructField("end_timestamp", T.DoubleType()),
    T.StructField("av_overlap_segment_hashes_stride1_v2", T.StringType())])

MANIFEST_STRINGS = ("scenario_id", "city", "status", "graph_path", "graph_sha256", "split", "split_group_id")


def scenario_folder() -> F.Column:
    """Name of the folder a row was read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)


def list_scenarios(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Scenario folders in name order, optionally the first `limit`."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{root}/*/scenario_*.parquet")
    names = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("scenario_id")).distinct().orderBy("scenario_id")
    return names if limit is None else names.limit(limit)


def schema_groups(spark: SparkSession, files: str, without: DataFrame | None = None) -> list[tuple[T.StructType, list[str]]]:
    """Files by the schema that reads them. Footers are read by the executors, and only the schemas that differ come to the driver.

    Files of one group differ at most in which columns they have and in the width of their numbers. Files in the folders of the scenarios `without` are left out.
    """
    listed = spark.read.format("binaryFile").load(files).select("path")
    if without is not None:
        named = listed.withColumn("scenario_id", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
        listed = named.join(without.select("scenario_id").distinct(), "scenario_id", "left_anti").select("path")

    def footers(batches):
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                where, name = pyarrow.fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as source:
                    schema = pq.read_schema(source)
                kinds = {f.name: "long" if pa.types.is_integer(f.type) else "double" if pa.types.is_floating(f.type) else "boolean" if pa.types.is_boolean(f.type) else "string" for f in schema}
                rows.append(",".join(f"{c}:{kinds[c]}" for c in FRAMES.names if c in kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["path", "kinds"])

    read = staged(listed.mapInArrow(footers, "path string, kinds string"), "footers")
    types = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
    groups: list[tuple[dict, list[str]]] = []
    for r in read.select("kinds").distinct().orderBy("kinds").collect():
        kinds = dict(x.split(":") for x in r["kinds"].split(",") if x)
        for known, members in groups:
            if all(known.get(c, k) == k for c, k in kinds.items()):
                known.update(kinds)
                members.append(r["kinds"])
                break
        else:
            groups.append((dict(kinds), [r["kinds"]]))
    schema = lambda kinds: T.StructType([T.StructField(c, types[kinds[c]]) for c in FRAMES.names if c in kinds])
    if len(groups) == 1 and without is None:
        return [(schema(groups[0][0]), [files])]
    return [(schema(kinds), [r["path"] for r in read.where(F.col("kinds").isin(members)).toLocalIterator()]) for kinds, members in groups]


def as_frames(df: DataFrame) -> list[F.Column]:
    """The columns of FRAMES, cast; absent ones are NULL."""
    return [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FRAMES.fields]


def read_frames(spark: SparkSession, root: str, without: DataFrame | None = None) -> DataFrame:
    """Track frames of all scenario folders, with `scenario_id` and the source file; files of the scenarios `without` are not opened.

    Numbers are cast to the types of FRAMES, so 32- and 64-bit files can be read, also side by side, and a column that only some
    files have keeps its values there and is NULL for the others.
    """
    files = f"{root}/*/scenario_*.parquet"
    parts = []
    for schema, paths in schema_groups(spark, files, without):
        df = spark.read.schema(schema).parquet(*paths)
        parts.append(df.select(scenario_folder().alias("scenario_id"), *as_frames(df), F.col("_metadata.file_path").alias("source_file")))
    if not parts:
        nothing = spark.createDataFrame([], FRAMES)
        return nothing.select(F.lit("").alias("scenario_id"), "*", F.lit("").alias("source_file"))
    return reduce(DataFrame.unionByName, parts)


def check_one_file(frames: DataFrame) -> DataFrame:
    """Scenarios whose frames come from more than one file."""
    return frames.groupBy("scenario_id").agg(F.count_distinct("source_file").alias("files")).where("files <> 1")


def read_maps(spark: SparkSession, root: str) -> DataFrame:
    """Map documents as text: (scenario_id, map_json)."""
    return spark.read.text(f"{root}/*/log_map_archive_*.json", wholetext=True).select(
        scenario_folder().alias("scenario_id"), F.col("value").alias("map_json"))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet or CSV by suffix, never inferred."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return spark.read.schema(schema).csv(path, header=True)


def read_group_metadata(spark: SparkSession, path: str, schema: T.StructType = GROUP_META) -> DataFrame:
    return read_table(spark, path, schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenario manifest; identifying columns are text, all other CSV columns numbers where they parse."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(c) if c in MANIFEST_STRINGS or c == "reason" else F.col(c).try_cast("double").alias(c)
                        for c in raw.columns])


def output_root(base: str, limit: int | None = None) -> str:
    """Partial builds get their own folder."""
    if limit is None:
        return base
    if limit <= 0:
        raise ValueError("limit must be positive")
    return f"{base}/partial_builds/limit_{limit}"


def write_graphs(nodes: DataFrame, edges: DataFrame, splits: DataFrame, root: str) -> str:
    """Node and edge tables, partitioned by split and city, published together; returns the version.

    Both go to a folder of a new version; only then a marker names it. Readers see
    the last marked version, so never nodes without their edges, and an interrupted write leaves no trace for them.
    """
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    where = splits.select("scenario_id", "split")
    for name, table in (("nodes", nodes), ("edges", edges)):
        by = [c for c in ("split", "city") if c == "split" or c in table.columns]
        table.join(where, "scenario_id").write.mode("errorifexists").partitionBy(*by).parquet(f"{root}/versions/{version}/{name}")
    number = 1 + len(_markers(spark, root))
    marker = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(version).alias("version"))
    marker.coalesce(1).write.mode("errorifexists").json(f"{root}/published/{number:08d}")
    return version


def _markers(spark: SparkSession, root: str) -> list[str]:
    """Published versions in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return []
    rows = spark.read.schema("number long, version string").json(f"{root}/published/*").orderBy("number").collect()
    return [r.version for r in rows]


def read_graphs(spark: SparkSession, root: str, split: str | None = None, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a version, the last published one if none is named, pruned to one split if given."""
    if version is None:
        published = _markers(spark, root)
        if not published:
            raise ValueError(f"nothing is published under {root}")
        version = published[-1]
    tables = [spark.read.parquet(f"{root}/versions/{version}/{name}") for name in ("nodes", "edges")]
    if split is not None:
        tables = [t.where(F.col("split") == split) for t in tables]
    return tables[0], tables[1]


def union_manifest(*parts: DataFrame) -> DataFrame:
    """Manifest rows with the union of all columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_manifest(manifest: DataFrame, summary: DataFrame, root: str) -> None:
    """Manifest and one-row JSON summary. Error rows go to `.failed` names and raise."""
    failed = manifest.where("status = 'error'").limit(1).count() > 0
    tail = ".failed" if failed else ""
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest{tail}")
    summary.write.mode("errorifexists").json(f"{root}/summary{tail}")
    if failed:
        raise RuntimeError(f"build has error rows, see {root}/manifest.failed")


def flag_errors(df: DataFrame, reasons: dict[str, F.Column]) -> DataFrame:
    """Adds `status` and `reason`: a bad row becomes an error row, the batch goes on."""
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()])
    return df.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "built").otherwise("error"))
