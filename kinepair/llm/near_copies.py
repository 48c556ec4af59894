"""Near copies by exact similarity: rows whose sets of WIDTH-word shingles have a Jaccard index of at least LEAST.

Two sets that similar share an element among the first few of each in any common order (prefix filter), so only those
are posted and no pair is lost. Rare shingles come first in the order: how common one is, is read off a table of SLOTS
counters by hash; a wrong guess there costs time and no result. Size and place of the shared shingle rule out most
pairs, and the rest is decided on the sets themselves.

Candidates come from SimHash first: a set's fingerprint is the bit majority of its shingle hashes, and sets whose fingerprints differ in at
most two bits, found through the grid of `simhash`, are compared on the sets. Most copies are linked by that. Similar sets may have
fingerprints farther apart, and a prefix filter finds those. In PIVOTS rounds, members of a posting are compared with one of them alone. Only pairs
that this leaves in different components are formed after that, so a large group of copies is hardly paired within itself.

Defined results: null and wordless texts have the empty set and are copies of each other; a text shorter than WIDTH words is one shingle;
words are told apart by 64-bit hashes after lower-casing A-Z. Of a component, the document with the smallest id stays, a null id
being larger than any, then the one with the smallest digest of its text; of rows with equal text and equal id, or without one, one stays, as they
are the same document; an empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.llm.common import Shipped, free_names, one_of_each, order_of, text_digest
from kinepair.llm.components import components
from kinepair.llm.simhash import links as close_fingerprints
from kinepair.llm.simhash import majority
from kinepair.sources.staging import discard, staged

WIDTH = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
SLOTS = 1 << 16
#: Bits of the map of texts that a round compares; a collision there costs time and no result.
MARKS = 1 << 23
#: Rounds of comparing with one member, after that of the fingerprints; their number does not touch the result.
PIVOTS = 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of all windows of words, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, dtype=np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ each[k:k + n]) * _ODD[k % len(_ODD)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * least[1] >= least[0] * (len(a) + len(b) - common)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def prefix(found: np.ndarray, common: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The first of the set in the common order, of which a similar set must share one."""
    n = len(found)
    order = np.lexsort((found, common[(found % np.uint64(SLOTS)).astype(np.int64)]))
    return found[order[:n - math.ceil(n * least[0] / least[1]) + 1]] if n else found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            total += np.bincount((shingles(text) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["k", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for n in batch.column(1).to_pylist():
            total += np.frombuffer(n, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["k", "n"])


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of shingles by slot; half a megabyte from each of a few tasks comes to the driver."""
    parts = docs.select("text").mapInArrow(_counted, "k long, n binary").repartition(8).mapInArrow(_added, "k long, n binary")
    total = np.zeros(SLOTS, dtype=np.int64)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r["n"], dtype=np.int64)
    return total


def _posted(counts: Shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.get()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            firsts = [prefix(s, common).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, firsts)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *firsts]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(set_key, sets), pa.binary()), pa.array(list(map(len, sets)), pa.int64()), flat,
                                              pa.array(np.array(list(map(majority, sets)), dtype=np.uint64).view(np.int64), pa.int64())],
                                             names=["doc_id", "digest", "set", "size", "first", "fp"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(MARKS, dtype=bool)
    for batch in batches:
        bits[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(MARKS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(MARKS // 8, dtype=np.uint8)
    for batch in batches:
        for b in batch.column(0).to_pylist():
            bits |= np.frombuffer(b, dtype=np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def marks(hashes: DataFrame) -> np.ndarray:
    """Bitmap of a column of hashes; a megabyte from each of a few tasks comes to the driver, one after the other."""
    bits = np.zeros(MARKS // 8, dtype=np.uint8)
    for r in hashes.mapInArrow(_marked, "bits binary").repartition(4).mapInArrow(_joined, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def _keyed(wanted: Shipped):
    """(set, text) of the texts whose hash is marked: all that are wanted, and a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.get()
        for batch in batches:
            place = (batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(MARKS)).astype(np.int64)
            taken = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
            texts = batch.column(0).filter(pa.array(taken.astype(bool))).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([set_key(shingles(t)) for t in texts], pa.binary()), pa.array(texts, pa.binary())], names=["set", "text"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        sets = {t: shingles(t) for t in {*x, *y}}
        keep = [similar(sets[s], sets[t]) for s, t in zip(x, y)]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep) if k], pa.binary()) for c in (a, b)], names=["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar; `texts` has one text for every set."""
    side = lambda name, text: texts.select(F.col("set").alias(name), F.col("text").alias(text))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verified, "a binary, b binary")


def _possible(p: str, q: str) -> Column:
    """Whether sets that share a shingle at these places in their orders, none before, can be similar."""
    size, place = (lambda s: F.col(f"{s}.size")), (lambda s: F.col(f"{s}.place"))
    # common * den >= num * (size + size - common), with common at most what follows the places.
    most = F.least(size(p) - place(p), size(q) - place(q))
    return most * (LEAST[0] + LEAST[1]) >= F.lit(LEAST[0]) * (size(p) + size(q))


def _led(known: DataFrame) -> DataFrame:
    """(set, root): the least set within two links. Sets with one root are connected; those of a large group nearly all share their pivot, so further steps gain little."""
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    once = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    back = both.join(once.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m"))
    return staged(once.join(back.withColumnRenamed("m", "m2"), "a").select(F.col("a").alias("set"), F.least("m", "m2").alias("root")), "near-led")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) sets with equal or close fingerprints; of each fingerprint (set, fp) the least set stands for it."""
    each = staged(sets.groupBy("fp").agg(F.min("set").alias("least"), F.count(F.lit(1)).alias("n")), "near-fingerprints")
    same = sets.join(each.where("n > 1").select("fp", "least"), "fp").where("set != least").select(F.col("set").alias("a"), F.col("least").alias("b"))
    ends = [each.select(F.col("fp").alias(f), F.col("least").alias(s)) for f, s in (("a", "x"), ("b", "y"))]
    close = close_fingerprints(each.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(close)


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) keys of similar sets, a < b: enough of them to connect whatever is connected by similar pairs."""
    sets = rows.where("size > 0").groupBy("set").agg(F.first("size").alias("size"), F.first("first").alias("first"))
    posts = staged(sets.select("set", "size", F.posexplode("first").alias("place", "shingle")), "near-posts")
    several = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle")
    now = staged(posts.join(several, "shingle", "left_semi").withColumn("root", F.col("set")), "near-open")
    hashed = F.xxhash64("digest")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def verified(pairs):
        # Texts are read again in each round, but only those of the pairs are shingled and sent.
        wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "near-wanted")
        bits = Shipped(docs.sparkSession, marks(rows.join(wanted, "set", "left_semi").select(hashed)))
        texts = docs.select("text", F.xxhash64(text_digest())).mapInArrow(_keyed(bits), "set binary, text binary")
        sure = staged(_verify(pairs, texts.join(wanted, "set", "left_semi").dropDuplicates(["set"])), "near-sure")
        bits.data.destroy()
        discard(wanted)
        return sure

    known = tried = None
    for k in range(PIVOTS + 2):
        p, q = now.alias("p"), now.alias("q")
        apart = (F.col("p.root") != F.col("q.root")) & _possible("p", "q")
        if k == 0:
            pairs = fingerprint_pairs(rows.where("size > 0").select("set", "fp").distinct())
        elif k <= PIVOTS:
            pivot = now.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("set", F.lit(k)).alias("turn"), "set", "size", "place", "root")).alias("q")).select("shingle", "q.*")
            pairs = p.join(pivot.alias("q"), (F.col("p.shingle") == F.col("q.shingle")) & apart)
        else:
            # Whatever is still apart and shares a posting is compared pair by pair.
            pairs = p.join(q, (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.set") < F.col("q.set")) & apart)
        if k > 0:
            pairs = pairs.select(F.col("p.set").alias("a"), F.col("q.set").alias("b"))
        pairs = pairs.select(*ordered).distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        sure = verified(pairs)
        known, tried = (sure, pairs) if tried is None else (known.unionByName(sure), tried.unionByName(pairs))
        if k <= PIVOTS:
            roots = _led(known)
            rooted = now.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
            mixed = rooted.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("shingle")
            now = staged(rooted.join(mixed, "shingle", "left_semi"), "near-open")
    return known


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document (id and text): doc_id, digest, set, root, kept."""
    counts = Shipped(docs.sparkSession, shingle_counts(docs))
    rows = staged(docs.select(F.col("doc_id").cast("long"), "text", text_digest().alias("digest"))
                  .mapInArrow(_posted(counts), "doc_id long, digest string, set binary, size long, first array<long>, fp long"), "near-rows")
    counts.data.destroy()
    each = rows.groupBy("doc_id", "digest").agg(F.first("set").alias("set"))
    roots = components(links(rows, docs))
    least = rows.groupBy("set").agg(F.min(order_of("digest")).alias("least"))
    rooted = staged(least.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("root", "set").alias("root"), "least"), "near-sets")
    first = rooted.groupBy("root").agg(F.min("least").alias("least"))
    labels = rooted.select("set", "root").join(first, "root")
    return each.join(labels, "set").select("doc_id", "digest", "set", "root", (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))).alias("kept"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, of the first document of each component."""
    groups = near_groups(docs)
    row, at, ident, digest = free_names(docs, "_row", "_digest", "_gone", "_of")
    keyed = docs.select(F.struct(*docs.columns).alias(row), text_digest().alias(at), F.col("doc_id").cast("long").alias("doc_id"))
    gone = groups.where("not kept").select(F.col("doc_id").alias(ident), F.col("digest").alias(digest))
    kept = keyed.join(gone, (F.col(at) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(ident)), "left_anti")
    # Repeats are few, or one text; only they are brought together.
    again = keyed.groupBy("doc_id", at).agg(F.count(F.lit(1)).alias(ident)).where(F.col(ident) > 1).select(F.col("doc_id").alias(ident), F.col(at).alias(digest))
    same = (F.col(at) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(ident))
    return kept.join(again, same, "left_anti").select(f"{row}.*").unionByName(one_of_each(kept.join(again, same, "left_semi"), ["doc_id", at], row))
