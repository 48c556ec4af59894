"""Faults of single scenarios, kept apart from the batch: a scenario that cannot be built becomes an error row, and all others are built.

A validation branch yields (scenario_id, stage, reason, detail), staged once. The scenarios it names are anti-joined before any feature work,
so their files are not even opened by the build. How many rows failed is measured by the job that writes the outcome.

Stages, in the order in which they are looked at: `file` (which files there are and whether they can be decoded to the end), `map` (the document), `frames` (the
rows). A scenario's error row has its first fault; the table of faults has all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.config import FUTURE_START, GRID_LEN
from kinepair.functions.scalar import finite
from kinepair.sources import tables
from kinepair.sources.lineage import KINDS
from kinepair.sources.staging import staged, staged_with

STAGES = ("file", "map", "frames")
FAULTS = ("scenario_id", "stage", "reason", "detail")
#: Columns without which no track can be built.
NEEDED = ("track_id", "object_type", "timestep", "observed", "position_x", "position_y", "velocity_x", "velocity_y", "heading")


def _reported(df: DataFrame, stage: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for every rule (fault, detail) that a row of `df` breaks; a NULL condition is no fault."""
    cells = [F.when(bad, F.struct(F.lit(name).alias("reason"), detail.cast("string").alias("detail"))) for name, (bad, detail) in rules.items()]
    return df.select("scenario_id", F.lit(stage).alias("stage"), F.explode(F.array_compact(F.array(*cells))).alias("_f")).select("scenario_id", "stage", "_f.*")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scenario_id, reason, detail) of files that cannot be decoded to the end, or lack columns; a batch of rows is held at a time."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for path, scenario in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                where, name = pyarrow.fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as source:
                    file = pq.ParquetFile(source)
                    known = [c for c in tables.FRAMES.names if c in file.schema_arrow.names]
                    absent = [c for c in NEEDED if c not in known]
                    if absent:
                        out.append((scenario, "missing_columns", ",".join(absent)))
                    for _ in file.iter_batches(batch_size=1 << 16, columns=known, use_threads=False):
                        pass
            except (pa.ArrowException, OSError) as fault:
                out.append((scenario, "unreadable_frames", f"{type(fault).__name__} in {path.rsplit('/', 1)[-1]}"))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else ((), (), ()))], names=["scenario_id", "reason", "detail"])


def file_faults(spark: SparkSession, root: str) -> DataFrame:
    """Folders without exactly one frame file and one map, and frame files that cannot be decoded. An empty file counts as absent.

    Frame files are decoded once more than the build does, by the executors; without that a broken page would end the whole build.
    """
    files = spark.read.format("binaryFile").load(f"{root}/*/*").select("path")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", F.element_at(F.split("path", "/"), -2).alias("scenario_id"), F.coalesce(*[F.when(name.rlike(p), k) for k, p in KINDS.items()]).alias("kind"))
    counts = files.groupBy("scenario_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    rules = {}
    for k in KINDS:
        rules |= {f"missing_{k}_file": (F.col(k) == 0, F.lit(0)), f"several_{k}_files": (F.col(k) > 1, F.col(k))}
    read = files.where("kind = 'frames'").select("path", "scenario_id").mapInArrow(_decoded, "scenario_id string, reason string, detail string")
    return _reported(counts, "file", rules).unionByName(read.select("scenario_id", F.lit("file").alias("stage"), "reason", "detail"))


def map_faults(maps: DataFrame) -> DataFrame:
    """Documents (scenario_id, map_json) that are no JSON to their end, or have no lane segments."""
    parsed = maps.select("scenario_id", F.try_parse_json("map_json").alias("doc"), F.coalesce(F.length("map_json"), F.lit(0)).alias("size"))
    lanes = F.try_variant_get("doc", "$.lane_segments", "map<string,variant>")
    return _reported(parsed, "map", {
        "unreadable_map": (F.col("doc").isNull(), F.concat("size", F.lit(" characters"))),
        "map_without_lanes": (F.col("doc").isNotNull() & (F.coalesce(F.size(lanes), F.lit(0)) <= 0), F.lit("lane_segments"))})


def frame_faults(frames: DataFrame) -> DataFrame:
    """Scenarios whose rows cannot make tracks: rows without track or step, steps off the grid, tracks without any finite position, recordings that end before the future begins, and more than one city.

    Two groupings, by track and by scenario, both of counts that are combined before they are shuffled.
    """
    t, place = F.col("timestep"), F.coalesce(finite(F.col("position_x")) & finite(F.col("position_y")), F.lit(False))
    city = F.col("city") if "city" in frames.columns else F.lit(None).cast("string")
    tracks = frames.groupBy("scenario_id", "track_id").agg(
        F.count_if(F.col("track_id").isNull() | t.isNull()).alias("unnamed"), F.count_if(~t.between(0, GRID_LEN - 1)).alias("off"),
        F.count_if(place).alias("placed"), F.max("timestep").alias("last"), F.min(city).alias("lo"), F.max(city).alias("hi"))
    lost = (F.col("placed") == 0) & F.col("track_id").isNotNull()
    found = tracks.groupBy("scenario_id").agg(
        F.sum("unnamed").alias("unnamed"), F.sum("off").alias("off"), F.count_if(lost).alias("lost"), F.min(F.when(lost, F.col("track_id"))).alias("first"),
        F.max("last").alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _reported(found, "frames", {
        "rows_without_key": (F.col("unnamed") > 0, F.col("unnamed")), "steps_off_grid": (F.col("off") > 0, F.col("off")),
        "track_without_positions": (F.col("lost") > 0, F.concat_ws(" ", "lost", F.lit("from"), "first")),
        "short_recording": (F.coalesce("last", F.lit(-1)) < FUTURE_START, F.coalesce("last", F.lit(-1))),
        "several_cities": (F.col("lo") != F.col("hi"), F.concat_ws(" ", "lo", "hi"))})


def validated(frames: DataFrame, maps: DataFrame | None = None, *earlier: DataFrame) -> DataFrame:
    """All faults of these rows and documents, and the `earlier` ones, staged."""
    parts = [*earlier, frame_faults(frames), *([map_faults(maps)] if maps is not None else [])]
    return staged(reduce(DataFrame.unionByName, [p.select(*FAULTS) for p in parts]), "faults")


def read_validated(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames and maps of the scenarios under `root` that have no fault, and the faults of the others."""
    broken = staged(file_faults(spark, root), "file-faults")
    frames, maps = tables.read_frames(spark, root, broken), admitted(tables.read_maps(spark, root), broken)
    faults = validated(frames, maps, broken)
    return admitted(frames, faults), admitted(maps, faults), faults


def admitted(table: DataFrame, faults: DataFrame) -> DataFrame:
    """Rows of scenarios without a fault."""
    return table.join(faults.select("scenario_id").distinct(), "scenario_id", "left_anti")


def error_rows(faults: DataFrame) -> DataFrame:
    """One row for each failed scenario: status `error`, its first fault by stage, reason and detail, and how many it has."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    first = F.min(F.struct(order.alias("at"), "stage", "reason", "detail")).alias("first")
    return faults.groupBy("scenario_id").agg(first, F.count(F.lit(1)).alias("num_faults")).select(
        "scenario_id", F.lit("error").alias("status"), F.col("first.reason").alias("reason"), F.col("first.detail").alias("detail"), "num_faults")


def outcome(built: DataFrame, faults: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Manifest of built or skipped scenarios and error rows, written once, and its numbers of rows by status, measured while it is written.

    A scenario that is both built and faulty would be counted twice; `built` is expected to come from `admitted` tables.
    """
    rows = tables.union_manifest(built, error_rows(faults))
    counts = [F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(s) for s in ("built", "exists", "skipped", "error")]
    return staged_with(rows, "outcome", *counts)


def build_isolated(spark: SparkSession, root: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """`outcome` of building all good scenarios under `root`: `build` takes frames and maps and returns manifest rows with `scenario_id` and `status`."""
    frames, maps, faults = read_validated(spark, root)
    return outcome(build(frames, maps), faults)
