"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: what every match must contain. Texts are
indexed in segments, a segment being some megabytes of neighbouring rows: postings lead
from a trigram to the segment's rows. Queries intersect and unite postings, and
the expression then verifies the candidates. Rules whose expression has no
mandatory trigram scan every text. Index and texts of a segment are in the same task, so nothing is shuffled.

Trigrams are over UTF-8 bytes with A-Z lower-cased; only trigrams that some rule asks for get postings.

Defined results: a null or empty text has no spans; an empty table gives an empty result; repeated rows are
scanned each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as c
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in order: name, expression over bytes, group and least length of that group's match. The first three are the base.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0),
    ("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", 0, 0),
)
BASE = ("assign", "access", "hex")
SEGMENT_BYTES = 4 << 20
#: Strings that a part of an expression may stand for before it is taken as open.
MOST_STRINGS = 64

Query = list[frozenset[bytes]] | None
"""Any of these sets of trigrams, each needed whole; None: no condition."""


def _of_strings(strings: set[bytes]) -> Query:
    if not strings or min(map(len, strings)) < 3:
        return None
    return [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return [x | y for x in a for y in b] if len(a) * len(b) <= MOST_STRINGS else min(a, b, key=len)


def _walk(nodes) -> tuple[Query, set[bytes] | None]:
    """Condition of a sequence, and the strings it stands for if they are few."""
    found, run, exact = None, {b""}, True
    for op, arg in nodes:
        query, strings = _node(op, arg)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            # The strings up to here end; what follows starts anew.
            found, run, exact = _both(_both(found, _of_strings(run)), query), {b""}, False
    return (found if exact else _both(found, _of_strings(run))), (run if exact else None)


def _node(op, arg) -> tuple[Query, set[bytes] | None]:
    if op is c.LITERAL:
        return None, {bytes([arg]).lower()}
    if op is c.IN:
        values: set[bytes] = set()
        for kind, v in arg:
            if kind is c.LITERAL:
                values.add(bytes([v]).lower())
            elif kind is c.RANGE and v[1] - v[0] < MOST_STRINGS:
                values |= {bytes([x]).lower() for x in range(v[0], v[1] + 1)}
            else:
                return None, None
        return None, values if len(values) <= 8 else None
    if op is c.SUBPATTERN:
        return _walk(arg[3])
    if op is c.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for _, s in parts) and sum(len(s) for _, s in parts) <= MOST_STRINGS:
            return None, set().union(*(s for _, s in parts))
        queries = [_of_strings(s) if s is not None else q for q, s in parts]
        return (None if any(q is None for q in queries) else [x for q in queries for x in q]), None
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, inner = arg
        query, strings = _walk(inner)
        if strings is not None and (low, high) == (0, 1):
            return None, strings | {b""}
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            out = {b""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return None, out
        return (None if low == 0 else query if strings is None else _of_strings(strings)), None
    return None, None


def trigram_query(pattern: str) -> Query:
    """The trigrams that a text must have to hold a match."""
    query, strings = _walk(_parser.parse(pattern.encode()))
    return query if strings is None else _of_strings(strings)


_FOLD = np.arange(256, dtype=np.int32)
_FOLD[ord("A"):ord("Z") + 1] += 32


def postings(texts: list[bytes], wanted: list[bytes]) -> dict[bytes, np.ndarray]:
    """Sorted row numbers of the texts with each wanted trigram; one pass over the segment, whatever their number."""
    joined = np.frombuffer(b"\xff".join(texts), dtype=np.uint8)
    if len(joined) < 3:
        return {}
    code = _FOLD[joined]
    code = code[:-2] << 16 | code[1:-1] << 8 | code[2:]
    number = {t: int.from_bytes(t, "big") for t in wanted}
    at = np.flatnonzero(_table(tuple(number.values()))[code])
    ends = np.cumsum([len(t) + 1 for t in texts])
    pairs = np.unique(code[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
    trigram, row = pairs // len(texts), pairs % len(texts)
    return {t: row[np.searchsorted(trigram, n, "left"):np.searchsorted(trigram, n, "right")] for t, n in number.items()}


_TABLES: dict[tuple[int, ...], np.ndarray] = {}


def _table(codes: tuple[int, ...]) -> np.ndarray:
    if codes not in _TABLES:
        _TABLES[codes] = np.zeros(1 << 24, dtype=bool)
        _TABLES[codes][list(codes)] = True
    return _TABLES[codes]


def candidates(query: Query, index: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
    """Rows that may match: for each alternative the shortest postings first, then united."""
    if query is None:
        return np.arange(rows)
    none, found = np.zeros(0, dtype=np.int64), []
    for need in query:
        lists = sorted((index.get(t, none) for t in need), key=len)
        now = lists[0]
        for other in lists[1:]:
            now = np.intersect1d(now, other, assume_unique=True)
        found.append(now)
    return np.unique(np.concatenate(found))


class Scanner:
    """Compiled rules with their queries."""

    def __init__(self, rules=RULES):
        self.rules = [(name, re.compile(p.encode()), trigram_query(p), group, least) for name, p, group, least in rules]
        self.wanted = sorted({t for _, _, q, _, _ in self.rules for need in q or () for t in need})

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of every text, sorted, in code points."""
        index = postings(texts, self.wanted)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (_, pattern, query, group, least) in enumerate(self.rules):
            for row in candidates(query, index, len(texts)).tolist():
                text = texts[row]
                for m in pattern.finditer(text):
                    if m.end(group) - m.start(group) >= least:
                        start = len(text[:m.start()].decode("utf-8", "replace"))
                        spans[row].append((start, number, start + len(m[0].decode("utf-8", "replace"))))
        return [sorted(s) for s in spans]


def segments(texts: list[bytes], size: int = SEGMENT_BYTES) -> Iterator[list[bytes]]:
    """The texts in runs of about `size` bytes."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, spans): all spans of every document as array of (kind, start, end), in order of start, then of the rules."""
    names = [r[0] for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = [s for part in segments(texts) for s in scanner.scan(part)]
            rows = pa.array([[{"kind": names[k], "start": a, "end": b} for a, k, b in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
