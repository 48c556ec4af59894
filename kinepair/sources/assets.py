"""Digests of files, digest lists, and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file held at a time.
BUFFER = 1 << 20
LINE = r"^([0-9a-f]{64})  (.+)$"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size in zip(*(c.to_pylist() for c in batch.columns)):
            # Names with a scheme are read as encoded ones, plain local names as they are.
            system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@") if "://" in path else path)
            digest, held = hashlib.sha256(), bytearray(BUFFER)
            with system.open_input_stream(inner, buffer_size=0) as stream:
                while n := stream.readinto(held):
                    digest.update(memoryview(held)[:n])
            yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest.hexdigest()], "size": pa.array([size], pa.int64())})


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """(path, sha256, size) of every matching file, of any size; the executors read each once, in pieces of a fixed size.

    Remote names are opened by the Arrow file system of their scheme (hdfs, s3, gs, abfs). The scan, which gives sizes only here, passes over empty files; they are added from the list of names that was made for it.
    """
    files = spark.read.format("binaryFile").load(glob)
    bare = F.regexp_replace("path", "^file:/*", "/").alias("path")
    sized = files.select(bare, "length")
    # Names come encoded, but with a plain plus sign.
    names = spark.createDataFrame([(v,) for v in files.inputFiles()], "path string").select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path")).select(bare)
    empty = names.join(sized, "path", "left_anti").select("path", F.sha2(F.lit(b""), 256).alias("sha256"), F.lit(0).cast("long").alias("size"))
    return sized.mapInArrow(_streamed, "path string, sha256 string, size long").unionByName(empty)


def parse_digest_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines `digest  path` as columns; malformed lines have NULL in both."""
    good = F.col(column).rlike(LINE)
    return lines.where(F.length(column) > 0).select(
        F.col(column).alias("line"), F.when(good, F.regexp_extract(column, LINE, 1)).alias("sha256"),
        F.when(good, F.regexp_extract(column, LINE, 2)).alias("path"))


def check_digest_lines(parsed: DataFrame) -> DataFrame:
    """Malformed lines and repeated paths: (rule, key, n)."""
    bad = parsed.where("path is null").groupBy(F.col("line").alias("key")).agg(F.count("*").alias("n")).select(
        F.lit("malformed").alias("rule"), "key", "n")
    twice = parsed.where("path is not null").groupBy(F.col("path").alias("key")).agg(F.count("*").alias("n")).where(
        "n > 1").select(F.lit("duplicate_path").alias("rule"), "key", "n")
    return bad.unionByName(twice)


def verify_assets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Full comparison of two (path, sha256) tables: ok, missing, changed or extra."""
    a = expected.select("path", F.col("sha256").alias("expected_sha256"))
    b = actual.select("path", F.col("sha256").alias("actual_sha256"))
    state = (F.when(F.col("actual_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "extra")
             .when(F.col("expected_sha256") == F.col("actual_sha256"), "ok").otherwise("changed"))
    return a.join(b, "path", "full").withColumn("state", state)


def digest_lines(assets: DataFrame) -> DataFrame:
    """Sorted `digest  path` lines."""
    return assets.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def verify_manifest_files(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Manifest rows whose file is missing or hashes to something else."""
    found = digests.select(F.col("path").alias("graph_path"), F.col("sha256").alias("actual_sha256"))
    return manifest.join(found, "graph_path", "left").where(~F.col("graph_sha256").eqNullSafe(F.col("actual_sha256")))


# Paths within a metadata document.
PROVENANCE = (
    "source_manifest_path string, source_metadata_path string, source_candidate_scores_path string,"
    " base_manifest_path string, fixed_alpha_audit_path string,"
    " shadow_fold_manifest struct<path: string, metadata_path: string>,"
    " surrogates array<struct<result_path: string, checkpoint_path: string,"
    " shadow_protocol: struct<strict_contract_path: string, surrogate_fit_manifest_path: string,"
    " surrogate_score_manifest_path: string>,"
    " strict_crossfit_release: struct<path: string,"
    " code_asset_manifest: struct<path: string, metadata_path: string>,"
    " strict_crossfit_asset_manifest: struct<path: string, metadata_path: string>,"
    " source_archive: struct<path: string, metadata_path: string>,"
    " base_poison_manifest: struct<path: string, metadata_path: string>>>>")


def asset_closure(documents: DataFrame, column: str = "metadata_json") -> DataFrame:
    """Every path named anywhere in the nested provenance documents, distinct."""
    d = documents.select(F.from_json(column, PROVENANCE).alias("d")).select("d.*")
    top = F.array("source_manifest_path", "source_metadata_path", "source_candidate_scores_path", "base_manifest_path",
                  "fixed_alpha_audit_path", "shadow_fold_manifest.path", "shadow_fold_manifest.metadata_path")

    def of_model(m):
        p, r = m["shadow_protocol"], m["strict_crossfit_release"]
        nested = [r[k][f] for k in ("code_asset_manifest", "strict_crossfit_asset_manifest", "source_archive",
                                    "base_poison_manifest") for f in ("path", "metadata_path")]
        return F.array(m["result_path"], m["checkpoint_path"], p["strict_contract_path"], p["surrogate_fit_manifest_path"],
                       p["surrogate_score_manifest_path"], r["path"], *nested)

    nested = F.flatten(F.transform(F.coalesce("surrogates", F.array()), of_model))
    return d.select(F.explode(F.concat(top, nested)).alias("path")).where(
        "path is not null and path <> ''").distinct()
