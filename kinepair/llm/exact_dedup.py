"""Exact deduplication through an extendible-hash index in shared files.

Every text has a 64-bit key. The upper bits name an owner, that is a range of keys; the lower
bits lead through a directory to a bucket. An overfull bucket is split by one
more bit, and the directory doubles when that bit is new to it. Texts with equal keys are
chained in their bucket and told apart by their bytes.

Copies within an input partition are combined before the shuffle, so an owner
gets each text at most once per partition, however often it occurs. Owners are as many as
keep an owner's share of the texts near OWNER_BYTES.

Defined results: a null text counts as empty; a null id is smaller than any
other; rows with equal text and equal id are the same document, and all of them
are marked kept if that id stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from kinepair.llm.common import one_of_each, skew_lookup, whole_text
from kinepair.sources.staging import shared_dir, staged

#: Bytes of text that an owner task is meant for, and entries of a bucket before it is split.
OWNER_BYTES = 32 << 20
BUCKET = 32

_PART = StructType([StructField("owner", IntegerType()), StructField("key", LongType()), StructField("sha", StringType()),
                    StructField("text", BinaryType()), StructField("top_id", LongType()), StructField("rows", LongType())])
_GROUP = StructType([StructField("sha", StringType()), StructField("keep_id", LongType()), StructField("group_size", LongType())])


def larger(a: int | None, b: int | None) -> int | None:
    """The larger id; null is the smallest."""
    return b if a is None else a if b is None else max(a, b)


class ExtendibleIndex:
    """Directory of buckets over the lower bits of 64-bit keys.

    A bucket is [depth, entries]; an entry is [key, sha, packed text, largest id, rows].
    """

    def __init__(self, bucket: int = BUCKET):
        self.bucket, self.depth, self.directory = bucket, 0, [[0, []]]

    def add(self, key: int, sha: str, text: bytes | None, top_id: int | None, rows: int) -> None:
        """Adds `rows` copies of a text. A copy already known by its digest may come without its bytes."""
        entries = self.directory[key & ((1 << self.depth) - 1)][1]
        for entry in entries:
            if entry[0] != key:
                continue
            # Equal keys are a chain: the bytes decide.
            if text is None and entry[1] == sha or text is not None and zstandard.decompress(entry[2]) == text:
                entry[3], entry[4] = larger(entry[3], top_id), entry[4] + rows
                return
            if text is not None and entry[1] == sha:
                raise ValueError(f"two different texts have the digest {sha}")
        entries.append([key, sha, zstandard.compress(text or b"", 1), top_id, rows])
        while len(entries) > self.bucket and len({e[0] for e in entries}) > 1:
            entries = self._split(key)

    def _split(self, key: int) -> list:
        """Splits the bucket of `key` by one more bit; returns the part that `key` falls into."""
        old = self.directory[key & ((1 << self.depth) - 1)]
        if old[0] == self.depth:
            self.directory, self.depth = self.directory * 2, self.depth + 1
        bit, halves = 1 << old[0], ([old[0] + 1, []], [old[0] + 1, []])
        for entry in old[1]:
            halves[bool(entry[0] & bit)][1].append(entry)
        for slot in range(key & (bit - 1), len(self.directory), bit):
            self.directory[slot] = halves[bool(slot & bit)]
        return self.directory[key & ((1 << self.depth) - 1)][1]

    def buckets(self) -> Iterator[list]:
        seen = set()
        for b in self.directory:
            if id(b) not in seen:
                seen.add(id(b))
                yield b

    def save(self, out: io.IOBase) -> None:
        """Buckets, each by itself, then the directory and a footer with its place."""
        places, at = {}, 0
        for b in self.buckets():
            data = pickle.dumps(b, 5)
            out.write(data)
            places[id(b)] = (at, len(data))
            at += len(data)
        data = pickle.dumps((self.bucket, self.depth, [places[id(b)] for b in self.directory]), 5)
        out.write(data)
        out.write(at.to_bytes(8, "little") + len(data).to_bytes(8, "little"))

    @classmethod
    def load(cls, source) -> ExtendibleIndex:
        """Reads a saved index; `source` can seek."""
        source.seek(source.size() - 16)
        tail = source.read(16)
        source.seek(int.from_bytes(tail[:8], "little"))
        size, depth, slots = pickle.loads(source.read(int.from_bytes(tail[8:], "little")))
        index, made = cls(size), {}
        for at, length in slots:
            if at not in made:
                source.seek(at)
                made[at] = pickle.loads(source.read(length))
        index.depth, index.directory = depth, [made[at] for at, _ in slots]
        return index


def _combine(bits: int):
    """Per input partition: each text once with its bytes, further copies as counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict[str, list] = {}

        def rows(found):
            return pa.RecordBatch.from_pylist([dict(zip(_PART.names, r)) for r in found], schema=schema)

        schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("top_id", pa.int64()), ("rows", pa.int64())])
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                sha = hashlib.sha256(text).hexdigest()
                if sha in more:
                    known = more[sha]
                    known[0], known[1] = larger(known[0], i), known[1] + 1
                else:
                    more[sha] = [None, 0]
                    key = int(sha[:16], 16)
                    out.append((key >> (64 - bits) if bits else 0, key - (1 << 64) * (key >> 63), sha, text, i, 1))
            if out:
                yield rows(out)
        rest = [(s, *v) for s, v in more.items() if v[1]]
        for at in range(0, len(rest), 10_000):
            yield rows([((k := int(s[:16], 16)) >> (64 - bits) if bits else 0, k - (1 << 64) * (k >> 63), s, None, top, n) for s, top, n in rest[at:at + 10_000]])

    return run


def _own(folder: str, before: str | None):
    """Owner task: the index of its key ranges, written as one file each; returns the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, ExtendibleIndex] = {}
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        late: dict[int, list] = {}
        for batch in batches:
            for owner, key, sha, text, top, n in zip(*(c.to_pylist() for c in batch.columns)):
                if owner not in indexes:
                    indexes[owner] = _opened(before, owner)
                # Counts may come ahead of the bytes from another partition; they wait for the end.
                if text is None:
                    late.setdefault(owner, []).append((key & ((1 << 64) - 1), sha, top, n))
                else:
                    indexes[owner].add(key & ((1 << 64) - 1), sha, text, top, n)
        for owner, index in indexes.items():
            for key, sha, top, n in late.get(owner, ()):
                index.add(key, sha, None, top, n)
            # Attempts write apart; the finished file is moved to its name.
            files.create_dir(root, recursive=True)
            mine = f"{root}/.{owner:06d}-{uuid.uuid4().hex}"
            with files.open_output_stream(mine, compression=None) as out:
                index.save(out)
            files.move(mine, f"{root}/{owner:06d}.idx")
            found = [(e[1], e[3], e[4]) for b in index.buckets() for e in b[1]]
            for at in range(0, len(found), 20_000):
                sha, top, n = zip(*found[at:at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(sha), pa.array(top, pa.int64()), pa.array(n, pa.int64())], names=_GROUP.names)

    return run


def _opened(before: str | None, owner: int) -> ExtendibleIndex:
    if before is None:
        return ExtendibleIndex()
    files, root = pyarrow.fs.FileSystem.from_uri(before)
    path = f"{root}/{owner:06d}.idx"
    if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return ExtendibleIndex()
    with files.open_input_file(path) as source:
        return ExtendibleIndex.load(source)


def owner_bits(docs: DataFrame) -> int:
    """Bits that name an owner: from the size of all texts, and enough for every shuffle partition."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(0, math.ceil(math.log2(max(1, size / OWNER_BYTES, least))))


def build_index(docs: DataFrame, folder: str, bits: int, before: str | None = None) -> DataFrame:
    """Writes the index of all texts, on top of the one in `before` if given, which needs the same `bits`.

    Returns the groups (sha, keep_id, group_size) that the owners of these texts hold, written.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_combine(bits), _PART)
    groups = parts.repartitionById(1 << bits, F.col("owner")).mapInArrow(_own(folder, before), _GROUP)
    return staged(groups, "exact-groups")


def groups_of(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Groups of equal texts, through a new index in `folder` (by default within the shared folder)."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/kinepair/exact-{uuid.uuid4().hex}"
    return build_index(docs, folder, owner_bits(docs))


def dedup(docs: DataFrame, folder: str | None = None, rows: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with `rows` also `row`, all its columns."""
    groups = groups_of(docs, folder)
    several = groups.where("group_size > 1")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    more = [F.struct(*docs.columns).alias("row")] if rows else []
    found = skew_lookup(docs.select("doc_id", F.sha2(whole_text().cast("binary"), 256).alias("sha"), *more), several, "sha", "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if rows else []))


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: of those with the largest id, or of all if none has one, a single row."""
    kept = dedup(docs, rows=True).where("kept")
    return kept.where("group_size = 1").select("row.*").unionByName(one_of_each(kept.where("group_size > 1"), ["text_sha256"], "row"))
