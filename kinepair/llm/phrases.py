"""Phrases that occur together more than their parts would suggest, per language.

Texts are read as bytes in numpy: words are runs between blanks and the signs that end a piece, and each word is known by a 64-bit code of its bytes and its
language. All words are counted; a seed under which two words share a code is not used. Then, for
phrases of 2 words, 3 words and so on, what may be frequent is narrowed by what cannot be wrong:

* every part one word shorter must be frequent (Apriori), looked up in a bitmap of hashed phrases;
* the occurrences of all phrases with the same hash, counted together, must reach the least count.

Bitmaps have a fixed size. They may let through too much, and never too little. The phrases that pass both are the candidates. Every task counts its own
while it finds them and hands them on in BLOCKS blocks by their hash. The candidates of a block are cut into tries of about PIECE, each a double array over the
digits of the words' numbers; the states of all that was handed on are moved on, digit by digit, and accepting states add up the tasks' counts by `bincount`. Candidates that
reach the least count are the phrases; counts are exact.

Texts are coded once, into a written table of runs of frequent words, which all later passes read. The number of passes is two a phrase length, however many
candidates there are; what is broadcast is bounded by the bitmap's size, whatever the corpus. Nothing is grouped by language before the final table of phrases.

Defined results: a null or empty text has no words; a null lang is `und`; rows are counted as often as they occur; ties of scores are ordered by count, then
by the phrase's bytes; languages without phrases give no rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinepair.llm.common import Shipped, small_batches
from kinepair.sources.staging import discard, staged, staged_with

LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase goes if a longer one that holds it has this percentage of its count.
COVERED = 50
UNKNOWN = "und"
#: Candidates in a trie at most.
PIECE = 300_000
#: Bits of bitmaps: fixed for words; for longer phrases by the number of words within these bounds.
WORD_BITS, FEWEST_BITS, MOST_BITS = 26, 16, 29
#: Bytes of text and positions worked on together; codes in a written row, far below what the collector treats as a large object.
PART, SLICE, CHUNK, PENDING, ROW = 1 << 18, 1 << 20, 1 << 16, 1 << 19, 1 << 12
BLOCKS = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1: blank between words, 2: end of a piece.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and their inverses."""
    if len(_POWERS.get("up", ())) < n:
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(n, x, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _values(seed: int) -> np.ndarray:
    """A number for each byte, the same for a letter in either case."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]


def find_words(data: np.ndarray, seed: int, classes: np.ndarray = _CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash of each word of the bytes, and whether a piece ends before it; worked through in parts that end between words."""
    values, out, at, ended = _values(seed), [], 0, True
    while at < len(data):
        stop = min(len(data), at + PART)
        if stop < len(data):
            gaps = np.flatnonzero(classes[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                # One word longer than the part: up to its end.
                while stop < len(data) and not classes[data[stop]]:
                    stop += 1
        part = data[at:stop]
        kind = classes[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], kind == 0, [False]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        up, down = _powers(len(part))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[part] * up)])
        code = (sums[ends] - sums[starts]) * down[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        before = breaks[starts] - np.concatenate([[0], breaks[ends[:-1]]]) > 0 if len(starts) else np.zeros(0, dtype=bool)
        if len(before):
            before[0] |= ended
            ended = bool(breaks[-1] - breaks[ends[-1]])
        else:
            ended |= bool(breaks[-1])
        out.append((starts + at, ends + at, code, before))
        at = stop
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of runs of rows of about SLICE bytes."""
    lang, text = batch.column(0), batch.column(1)
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
        yield lang.slice(at, stop - at), pc.fill_null(text.slice(at, stop - at).cast(pa.large_binary()), b"")
        at = stop


def coded(lang: pa.Array, text: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and for each word its start, end, code (never 0), and whether a piece ends before it. Every text ends with a line end here."""
    joined = pc.binary_join_element_wise(text, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    bounds = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[:bounds[-1]]
    starts, ends, code, before = find_words(data, seed)
    seeds = {v: xxhash.xxh64_intdigest((UNKNOWN if v is None else v).encode(), seed) for v in pc.unique(lang).to_pylist()}
    own = np.array([seeds[v] for v in lang.to_pylist()], dtype=np.uint64)
    code = mixed(code ^ own[np.searchsorted(bounds[1:], starts, side="right")])
    code[code == 0] = 1
    return data, starts, ends, code, before


def _counted(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _slices(batch):
                data, starts, ends, code, _ = coded(lang, text, seed)
                kinds, first, n = np.unique(code, return_index=True, return_counts=True)
                low, sizes = _LOWER[data].tobytes(), np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False) + 1)
                words = [low[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                owner = pc.fill_null(lang, UNKNOWN).take(pa.array(np.searchsorted(sizes, starts[first], side="right")))
                yield pa.RecordBatch.from_arrays([owner, pa.array(words, pa.binary()), pa.array(kinds.view(np.int64)), pa.array(n)], names=["lang", "word", "code", "n"])

    return run


def word_table(docs: DataFrame, seed: int = 1) -> tuple[DataFrame, int]:
    """(lang, word, code, n) of all words, written, and the seed under which no two of them share a code."""
    while True:
        found = docs.select(F.col("lang").cast("string"), "text").mapInArrow(_counted(seed), "lang string, word binary, code long, n long")
        words = staged(found.groupBy("lang", "word", "code").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("code").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() == 0:
            return words, seed
        discard(words)
        seed += 1


class Bitmap:
    """A set of hashed phrases that may hold more than it was given."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits, self.width = bits, max(1, (1 << bits) // BLOCKS // 8)
        self.table = np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8)
        for k, part in blocks.items():
            self.table[k * self.width:k * self.width + len(part)] = np.frombuffer(part, dtype=np.uint8)

    def holds(self, key: np.ndarray) -> np.ndarray:
        at = key >> np.uint64(64 - self.bits)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def phrase_key(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` codes from each position on."""
    n = max(0, len(codes) - size + 1)
    key = codes[:n].copy()
    for k in range(1, size):
        key = mixed(key * np.uint64(_BASE) + codes[k:k + n])
    return key


def _sparse(at: np.ndarray, n: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Sorted places and amounts, one row for each block of `block` places."""
    owner = at // block
    cut = np.flatnonzero(np.diff(owner)) + 1
    parts = [(int(owner[a]), (at[a:b] - owner[a] * block).astype(np.uint32).tobytes(), n[a:b].tobytes()) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]) if b > a]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary()))], names=["block", "at", "n"])


_SPARSE = "block int, at binary, n binary"


def _bits(width: int, least: int):
    """Blocks as bitmaps of the places whose amounts reach `least`; amounts are capped there before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        # Sums are cut at `least` each time, so small counters do.
        kind = np.uint8 if least < 128 else np.int64
        for batch in batches:
            for block, place, n in zip(batch.column(0).to_pylist(), _views(batch.column(1), np.uint32), _views(batch.column(2), np.int32)):
                if block not in sums:
                    sums[block] = np.zeros(width, dtype=kind)
                # Places of one row are distinct.
                sums[block][place] = np.minimum(sums[block][place] + n, least).astype(kind)
        for block, mine in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(mine >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _bitmap(sparse: DataFrame, bits: int, least: int) -> Bitmap:
    """Adds the parts of each block in one task; the driver receives at most 2 ** bits bits."""
    blocks = sparse.repartition("block").mapInArrow(_bits((1 << bits) // BLOCKS, least), "block int, bits binary")
    return Bitmap(bits, {r["block"]: bytes(r["bits"]) for r in blocks.toLocalIterator()})


def _hashed(bits: int, least: int):
    """Sparse marks of phrases given by columns of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c.to_numpy().view(np.uint64) for c in batch.columns]
            key = codes[0]
            for c in codes[1:]:
                key = mixed(key * np.uint64(_BASE) + c)
            at = np.unique((key >> np.uint64(64 - bits)).astype(np.int64))
            yield from _sparse(at, np.full(len(at), least, dtype=np.int32), (1 << bits) // BLOCKS)

    return run


def _encoded(seed: int, frequent: Shipped):
    """Runs of frequent words: codes with one 0 between runs; single words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = frequent.get()
        for batch in batches:
            for lang, text in _slices(batch):
                _, _, _, code, before = coded(lang, text, seed)
                keep = mine.holds(code)
                # A word joins the one before if both are frequent and no piece ends between them.
                joins = keep[1:] & keep[:-1] & ~before[1:]
                linked = np.concatenate([[False], joins]) | np.concatenate([joins, [False]]) if len(code) else keep
                at = np.flatnonzero(linked)
                first = np.concatenate([[False], ~joins])[at] if len(code) else linked[at]
                # A 0 goes before every first word of a run.
                place = np.arange(len(at)) + np.cumsum(first)
                out = np.zeros(len(at) + int(first.sum()) + 1, dtype=np.uint64)
                out[place] = code[at]
                ends = np.flatnonzero(out == 0)
                begin = 0
                while begin < len(out) - 1:
                    k = int(np.searchsorted(ends, begin + ROW))
                    stop = int(ends[min(k, len(ends) - 1)])
                    yield pa.RecordBatch.from_arrays([pa.array([out[begin:stop + 1].tobytes()], pa.binary())], names=["codes"])
                    begin = stop

    return run


def windows(codes: np.ndarray, size: int, parts: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of phrases of `size` words within a run, of which all parts one word shorter are in the bitmap, and their hashes."""
    n = max(0, len(codes) - size + 1)
    good = np.ones(n, dtype=bool)
    for k in range(size):
        good &= codes[k:k + n] != 0
    if parts is not None:
        within = parts.holds(phrase_key(codes, size - 1))
        good &= within[:n] & within[1:n + 1]
    at = np.flatnonzero(good)
    return at, phrase_key(codes, size)[at]


def _views(column: pa.Array, kind: type) -> Iterator[np.ndarray]:
    """The bytes of each row as numbers, where they lie."""
    return (np.frombuffer(v.as_buffer(), dtype=kind) for v in column)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows put together to about CHUNK codes; as a row begins and ends with 0, no run reaches into the next."""
    held, total = [], 0
    for batch in batches:
        for codes in _views(batch.column(0), np.uint64):
            held.append(codes)
            total += len(codes)
            if total >= CHUNK:
                yield np.concatenate(held)
                held, total = [], 0
    if held:
        yield np.concatenate(held)


def _bucketed(size: int, bits: int, least: int, parts: Shipped | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, held, total = parts and parts.get(), [], 0

        def flush():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            yield from _sparse(at, np.minimum(n, least).astype(np.int32), (1 << bits) // BLOCKS)

        for codes in _chunks(batches):
            held.append((windows(codes, size, shorter)[1] >> np.uint64(64 - bits)).astype(np.int64))
            total += len(held[-1])
            if total >= PENDING:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()

    return run


def _candidates(size: int, parts: Shipped | None, counted: Shipped):
    """Each task's own candidates with their occurrences there, in one row for each of BLOCKS parts of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, enough, held, total = parts and parts.get(), counted.get(), [], 0

        def flush():
            key, *words, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, words, n = key[order], [w[order] for w in words], n[order]
            # Equal phrases have equal keys; if two phrases share a key, both are passed on.
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            for w in words:
                new[1:] |= w[1:] != w[:-1]
            return [key[new], *(w[new] for w in words), np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n]

        def out(columns):
            key, *words, n = columns
            block, words = (key >> np.uint64(56)).astype(np.int64), np.stack(words, axis=1)
            cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            rows = [(int(block[a]), words[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cut, cut[1:]) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["block", "words", "n"])

        for codes in _chunks(batches):
            at, key = windows(codes, size, shorter)
            ok = enough.holds(key)
            at = at[ok]
            held.append([key[ok], *(codes[at + k] for k in range(size)), np.ones(len(at), dtype=np.int64)])
            total += len(at)
            if total >= PENDING:
                held = [flush()]
                total = len(held[0][0])
                if total >= PENDING // 2:
                    yield from out(held[0])
                    held, total = [], 0
        if total:
            yield from out(flush())

    return run


class DoubleArray:
    """Trie of equally long phrases: from state s, digit d leads to base[s] + d if check says that it came from s.

    Symbols are the bytes of a word's number in the sorted alphabet of the trie's words, so a state has at most 256 ways on.
    """

    def __init__(self, phrases: np.ndarray):
        self.alphabet = np.unique(phrases)
        ids = np.searchsorted(self.alphabet, phrases)
        self.digits = max(1, (max(1, len(self.alphabet) - 1).bit_length() + 7) // 8)
        rows = np.stack([ids[:, k] >> (8 * d) & 255 for k in range(phrases.shape[1]) for d in range(self.digits - 1, -1, -1)], axis=1)
        order = np.lexsort(rows.T[::-1])
        rows, self.phrases = rows[order], phrases[order]
        # Nodes by level: a new one wherever a prefix differs from that of the row before.
        differs = np.zeros(len(rows), dtype=bool)
        differs[0] = True
        parent, digit, node, count = [], [], np.zeros(len(rows), dtype=np.int64), 1
        for k in range(rows.shape[1]):
            differs[1:] |= rows[1:, k] != rows[:-1, k]
            parent.append(node[differs])
            digit.append(rows[differs, k])
            node = count - 1 + np.cumsum(differs)
            count += int(differs.sum())
        base, slots, size = _place(np.concatenate(parent), np.concatenate(digit), count)
        self.base, self.check, self.leaf = np.zeros(size + 256, dtype=np.int32), np.full(size + 256, -1, dtype=np.int32), np.full(size + 256, -1, dtype=np.int32)
        self.base[slots] = base
        self.check[slots[1:]] = slots[np.concatenate(parent)]
        self.leaf[slots[node]] = np.arange(len(rows))

    def count(self, codes: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of each phrase, in the order of `phrases`; with `times`, those at a position count that often."""
        size = self.phrases.shape[1]
        ids = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        known = self.alphabet[ids] == codes
        n = max(0, len(codes) - size + 1)
        good = np.ones(n, dtype=bool)
        for k in range(size):
            good &= known[k:k + n]
        at = np.flatnonzero(good)
        state = np.zeros(len(at), dtype=np.int64)
        for k in range(size):
            for d in range(self.digits - 1, -1, -1):
                to = self.base[state] + (ids[at + k] >> (8 * d) & 255)
                on = self.check[to] == state
                at, state = at[on], to[on].astype(np.int64)
        # Sums of weights are doubles, exact up to 2 ** 53.
        return np.bincount(self.leaf[state], None if times is None else times[at], len(self.phrases)).astype(np.int64)


def _place(parent: np.ndarray, digit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Base of each node, slot of each node (the root at 0), and the slots used in all; node i + 1 is child `digit[i]` of `parent[i]`.

    Nodes with many children are placed first, at drawn bases where all of their slots are free; after some draws, behind all others. Nodes with one
    child fill what is left.
    """
    rng, size = np.random.default_rng(11), 512 + 2 * count
    used = np.zeros(size, dtype=bool)
    used[0] = True
    first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
    width = np.diff(np.append(first, len(parent)))
    base, bases = np.zeros(count, dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    limits = [256, 128, 64, 32, 16, 8, 4, 2, 1]
    for most, fewest in zip(limits, limits[1:]):
        open_, draws = np.flatnonzero((width <= most) & (width > fewest)), 0
        while len(open_):
            n = width[open_]
            child = np.repeat(first[open_] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if draws < 24:
                drawn = rng.integers(1, size - 256, len(open_))
            else:
                drawn = size + 256 * np.arange(len(open_))
                used = np.concatenate([used, np.zeros(256 * len(open_), dtype=bool)])
                size = len(used)
            slots = np.repeat(drawn, n) + digit[child]
            taken = used[slots]
            alone = np.zeros(len(slots), dtype=bool)
            alone[np.unique(slots, return_index=True)[1]] = True
            failed = np.logical_or.reduceat(taken | ~alone, np.cumsum(n) - n)
            bases[open_[~failed]] = drawn[~failed]
            used[slots[np.repeat(~failed, n)]] = True
            open_, draws = open_[failed], draws + 1
    single = np.flatnonzero(width == 1)
    free = np.flatnonzero(~used)
    free = free[free >= 256][:len(single)]
    if len(free) < len(single):
        free = np.concatenate([free, np.arange(size, size + len(single) - len(free))])
        size = int(free[-1]) + 1
    bases[single] = free - digit[first[single]]
    base[parent[first]] = bases
    slots = np.concatenate([[0], np.repeat(bases, width) + digit])
    return base, slots, size


#: Phrases handed on together.
_SUMS = 8192


def _accepted(size: int, least: int, piece: int):
    """Phrases of each block that reach `least`: its candidates are cut into tries of about `piece`, and accepting states add up the tasks' occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, words, n in zip(batch.column(0).to_pylist(), _views(batch.column(1), np.uint64), _views(batch.column(2), np.int64)):
                held.setdefault(block, []).append((words.reshape(-1, size), n))
        while held:
            words, n = (np.concatenate(x) for x in zip(*held.popitem()[1]))
            key = words[:, 0]
            for k in range(1, size):
                key = mixed(key * np.uint64(_BASE) + words[:, k])
            lots = -(-len(words) // piece)
            lot = key % np.uint64(lots)
            for k in range(lots):
                mine = np.flatnonzero(lot == k)
                if not len(mine):
                    continue
                trie = DoubleArray(np.unique(words[mine], axis=0))
                # A 0 between the phrases, so none begins in one and ends in the next.
                runs, times = np.zeros((len(mine), size + 1), dtype=np.uint64), np.zeros((len(mine), size + 1), dtype=np.int64)
                runs[:, :size], times[:, 0] = words[mine], n[mine]
                total = trie.count(runs.ravel(), times.ravel())
                at = np.flatnonzero(total >= least)
                for a in range(0, len(at), _SUMS):
                    some = at[a:a + _SUMS]
                    found = trie.phrases[some].view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(pa.array(found[:, j]) for j in range(size)), pa.array(total[some])], names=[*(f"w{j}" for j in range(size)), "n"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, dict[int, DataFrame]]:
    """All words (lang, word, code, n), and by length the frequent phrases: codes w0, w1, ... and n; all written."""
    spark = docs.sparkSession
    words, seed = word_table(docs)
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, int(total).bit_length()))
    marks = words.where(F.col("n") >= least).select("code").mapInArrow(_hashed(WORD_BITS, least), _SPARSE)
    frequent = Shipped(spark, _bitmap(marks, WORD_BITS, least))
    codes = staged(docs.select(F.col("lang").cast("string"), "text").mapInArrow(_encoded(seed, frequent), "codes binary"), "phrase-codes")
    frequent.data.destroy()
    parts, out = None, {}
    for size in range(2, longest + 1):
        names = [f"w{k}" for k in range(size)]
        counted = Shipped(spark, _bitmap(codes.mapInArrow(_bucketed(size, bits, least, parts), _SPARSE), bits, least))
        schema = ", ".join(f"{w} long" for w in names)
        found = codes.mapInArrow(_candidates(size, parts, counted), "block int, words binary, n binary").repartition("block")
        whole, made = staged_with(found.mapInArrow(_accepted(size, least, PIECE), f"{schema}, n long"), f"phrases-{size}", F.count(F.lit(1)).alias("n"))
        counted.data.destroy()
        if parts is not None:
            parts.data.destroy()
        if not made["n"]:
            break
        out[size] = whole
        if size < longest:
            parts = Shipped(spark, _bitmap(whole.select(*names).mapInArrow(_hashed(bits, least), _SPARSE), bits, least))
    discard(codes)
    return words, out


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact: counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 or 3 words."""
    with small_batches(docs.sparkSession):
        words, found = frequent_phrases(docs, least, LONGEST)
    empty = docs.sparkSession.createDataFrame([], "w0 long, w1 long, w2 long, n long")
    pairs, triples = found.get(2, empty.drop("w2")), found.get(3, empty)
    frequent = words.where(F.col("n") >= least)
    lone = lambda k, f: frequent.select(F.col("code").alias(f"w{k}"), F.col("word").cast("string").alias(f"t{k}"), F.col("n").alias(f), *([F.col("lang")] if k == 0 else []))
    inside = F.explode(F.array(F.struct(F.col("w0"), F.col("w1")), F.struct(F.col("w1").alias("w0"), F.col("w2").alias("w1"))))
    longer = triples.select(inside.alias("p"), "n").groupBy("p").agg(F.max("n").alias("most")).select("p.*", "most")
    kept = pairs.join(longer, ["w0", "w1"], "left").where(~F.coalesce(F.lit(100) * F.col("most") >= F.lit(covered) * F.col("n"), F.lit(False)))
    two = kept.join(lone(0, "l"), "w0").join(lone(1, "r"), "w1").select(
        "lang", F.concat_ws(" ", "t0", "t1").alias("phrase"), F.col("n").alias("a"), "l", "r", _score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    three = (triples.join(lone(0, "f0"), "w0").join(frequent.select(F.col("code").alias("w1"), F.col("word").cast("string").alias("t1")), "w1").join(lone(2, "f2"), "w2")
             .join(pairs.withColumnRenamed("n", "f01"), ["w0", "w1"]).join(pairs.select(F.col("w0").alias("w1"), F.col("w1").alias("w2"), F.col("n").alias("f12")), ["w1", "w2"]))
    three = three.withColumns({"s1": _score(F.col("n"), F.col("f0"), F.col("f12")), "s2": _score(F.col("n"), F.col("f01"), F.col("f2"))})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "t0", "t1", "t2").alias("phrase"), F.col("n").alias("a"), F.when(early, F.col("f0")).otherwise(F.col("f01")).alias("l"),
                         F.when(early, F.col("f12")).otherwise(F.col("f2")).alias("r"), F.least("s1", "s2").alias("score"))
    scored = two.unionByName(three)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each of 64 parts of a language first gives its own best.
    part = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = part.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
