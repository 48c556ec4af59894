"""Near-duplicates by SimHash, found through a grid over segment bit counts.

The bits of a fingerprint are counted in each of SEGMENTS segments. Two
fingerprints differ in at least as many bits as their counts differ in sum (Manhattan distance), so
pairs within `RADIUS` bits have count vectors within that distance, and there is a grid point within half of
it from both. Each distinct fingerprint is therefore entered at its own grid point and at
all points one step away, pairs meet at a shared point, and the exact bit distance decides.
A pair within two bits also agrees fully in one of three blocks of bits, so the
block is part of the key: crowded grid points are split without losing a pair.

Only distinct fingerprints are joined; copies follow their fingerprint. Documents are
never paired with each other.

Defined results: a null or wordless text has fingerprint zero, which is linked
like any other; a null id is smaller than none: a component of null ids only
has a null id; repeated rows are returned each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.llm.common import order_of, skew_lookup, text_digest
from kinepair.llm.components import components
from kinepair.sources.staging import measured_joins, staged

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENTS = 4
#: First and last bit of the blocks, of which a pair within RADIUS bits agrees in one at least.
BLOCKS = ((0, 21), (21, 42), (42, 64))


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of every window of words, lower-cased in A-Z; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1:])]


def fingerprint(text: bytes) -> int:
    """A bit is 1 if set in over half of the shingle hashes."""
    return majority(np.array(shingle_hashes(text), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())], names=["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp) with the fingerprint as the long of the same bits."""
    return docs.select(F.col("doc_id").cast("long"), "text", text_digest().alias("digest")).mapInArrow(_fingerprints, "doc_id long, digest string, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the four 16-bit segments, each in 16 bits of a long."""
    segments = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(SEGMENTS)]
    return sum(F.shiftleft(F.bit_count(x).cast("long"), 16 * k) for k, x in enumerate(segments))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprints, a < b, that differ in at most RADIUS bits; `distinct` has each `fp` once."""
    def count(k):
        return F.shiftright(F.col("c"), 16 * k).bitwiseAND(F.lit(0xFFFF))
    points = F.array(F.col("c"),
                     *[F.when(count(k) < 16, F.col("c") + F.lit(1 << 16 * k)) for k in range(SEGMENTS)],
                     *[F.when(count(k) > 0, F.col("c") - F.lit(1 << 16 * k)) for k in range(SEGMENTS)])
    blocks = F.array(*[F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) * 4 + j for j, (lo, hi) in enumerate(BLOCKS)])
    grid = (distinct.select("fp", segment_counts(F.col("fp")).alias("c")).select("fp", F.explode(F.array_compact(points)).alias("point"), blocks.alias("blocks"))
            .select("fp", "point", F.explode("blocks").alias("block")))
    left, right = grid.withColumnRenamed("fp", "a"), grid.withColumnRenamed("fp", "b")
    near = left.join(right, ["point", "block"]).where("a < b and bit_count(a ^ b) <= 2")
    return near.select("a", "b").distinct()


def _labelled(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, digest, fp, least (the first document of its component, by id, null last, and digest)."""
    # The grid has 27 rows a fingerprint, and by the planner's estimate the bytes of one: a side that it takes for small fills the driver.
    measured_joins(docs.sparkSession)
    rows = staged(fingerprints(docs), "fingerprints")
    each = staged(rows.groupBy("fp").agg(F.min(order_of("digest")).alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(each.select("fp")))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Roots with more than one fingerprint are the few that were linked; the others keep their own first document.
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    labels = rooted.join(least, "root", "left").select("fp", "n", F.coalesce("least", "id").alias("least"))
    total = each.agg(F.sum("n")).first()[0] or 0
    return skew_lookup(rows, staged(labels, "labels"), "fp", "n", total)


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id of all documents reachable over links)."""
    return _labelled(docs).select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, of the first document of each component; rows with equal id and text are one document."""
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    gone = _labelled(docs).where(~stays).select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest")).distinct()
    return docs.withColumn("_of", text_digest()).join(gone, (F.col("_of") == F.col("_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")), "left_anti").select(*docs.columns)
