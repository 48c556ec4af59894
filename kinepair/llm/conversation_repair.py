"""Repair of conversation structure with fewest edits.

Rows of a conversation, in the order of their turns, are kept, given another role or deleted, and empty rows are
inserted, so that the roles become an optional system row followed by user and assistant in turn. Costs are given below. A row's faults
(no text, a repeat, no end mark) are found first.

A node is (rows read, state); the states are the start, and after a system, user or assistant row. Costs to the end are
computed backwards for all conversations of a batch side by side, row by row. An arc is optimal if its cost and the cost left behind it add up to
the cost left before it; its letter is the edit's initial. Nodes are then ranked by the least text of their first 1, 2, 4, ... letters: the rank for
twice the length is that of the pair of its own rank and the rank of the node that its doubled pointer leads to. The
final ranks say which of a node's optimal arcs begins the least text, and the doubled pointers of these arcs give every letter of a
conversation's audit at once.

Conversations are brought together by one shuffle and sorted; short ones are worked on in batches. A conversation's result is one cell
with a letter for each row and one digest over all of its text in order, so one task reads its rows. It reads them twice in a stream, first without
their texts, to decide, then with them, to apply; it holds some hundred bytes for each row of the batch at hand and two for each decided row, and never the texts.

Defined results: null fields count as one space; rows of equal turn are taken in the order of role and digest of the text, null turns first; equal rows are
rows of their own; a role counts by its first letter; a conversation without rows after damage has an empty audit; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of edits.
REROLE, DELETE, INSERT, OPEN_END = 2, 3, 2, 1
#: States: start, after system, after user, after assistant; and the end as a node of its own.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
#: Rows that are repaired together; a longer conversation is repaired by itself.
BATCH = 20_000
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = "\t\n\x0b\x0c\r "


def _next(letter: str) -> np.ndarray:
    """State after a row with this role initial is kept in each state, -1 where it may not stand."""
    return {"s": np.array([SYSTEM, -1, -1, -1]), "u": np.array([USER, USER, -1, USER]), "a": np.array([-1, -1, ASSISTANT, -1])}.get(letter, np.full(4, -1))


#: State after the row that the rules ask for next, inserted or given that role; after the start it is a user row.
WANTED = np.array([USER, USER, ASSISTANT, USER])
LETTERS = "sua"
KEPT = np.stack([_next(x) for x in (*LETTERS, "")])


def costs(initial: np.ndarray, fault: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least cost to the end of each node; conversation c has the nodes first[c] + c ... first[c] + c + size[c], four states each."""
    left = np.full((len(initial) + len(size), 4), FAR, dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    base = (first + np.arange(len(size)))[order]
    ends, rows = size[order], first[order]

    def insert(now: np.ndarray) -> np.ndarray:
        now[:, USER] = np.minimum(now[:, USER], now[:, ASSISTANT] + INSERT)
        for s in (START, SYSTEM, ASSISTANT):
            now[:, s] = np.minimum(now[:, s], now[:, USER] + INSERT)
        return now

    left[base + ends] = insert(np.tile(np.array([0, FAR, FAR, 0]), (len(size), 1)))
    longest = int(ends[0]) if len(ends) else 0
    for back in range(1, longest + 1):
        live = int(np.searchsorted(-ends, -back, side="right"))
        at = base[:live] + ends[:live] - back
        row = rows[:live] + ends[:live] - back
        after, kind = left[at + 1], fault[row]
        now = after + DELETE
        stays = np.where((kind == BLANK) | (kind == DUPLICATE), FAR, np.where(kind == TRUNCATED, OPEN_END, 0))[:, None]
        kept = KEPT[initial[row]]
        now = np.minimum(now, np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0), 1), FAR) + stays)
        now = np.minimum(now, after[:, WANTED] + stays + REROLE)
        left[at] = insert(now)
    return left


def optimal_arcs(left: np.ndarray, initial: np.ndarray, fault: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, letter, node) of the arcs on cheapest ways; node 4 * i + s is state s before row i of the conversations laid end to end."""
    nodes = np.arange(len(left))
    row_at = np.arange(len(initial)) + conv
    stays = np.where((fault == BLANK) | (fault == DUPLICATE), FAR, np.where(fault == TRUNCATED, OPEN_END, 0))
    src, letter, dst = [], [], []

    def add(at: np.ndarray, to: np.ndarray, s: int, state: np.ndarray, cost: np.ndarray | int, mark: str) -> None:
        ok = (state >= 0) & (left[at, s] < FAR) & (left[at, s] == left[to, np.maximum(state, 0)] + cost)
        src.append(4 * at[ok] + s)
        dst.append(4 * to[ok] + state[ok])
        letter.append(np.full(int(ok.sum()), ord(mark)))

    for s in range(4):
        add(row_at, row_at + 1, s, np.full(len(row_at), s), DELETE, "D")
        add(row_at, row_at + 1, s, KEPT[initial, s], stays, "K")
        add(row_at, row_at + 1, s, np.full(len(row_at), WANTED[s]), stays + REROLE, "R")
        add(nodes, nodes, s, np.full(len(nodes), WANTED[s]), INSERT, "I")
    return np.concatenate(src), np.concatenate(letter), np.concatenate(dst)


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].ravel()


def rank_paths(src: np.ndarray, letter: np.ndarray, dst: np.ndarray, count: int, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First letter of each node's least text (0 at its end), and pointers to the node 1, 2, 4, ... letters on.

    A node without arcs is an end; the pointers of ends lead to themselves. Letters of a node's arcs
    differ, so texts of equal rank that begin at one node have one way between them, and a pointer is enough.
    """
    order = np.lexsort((letter, src))
    src, letter, dst = src[order], letter[order], dst[order]
    head = np.zeros(count, dtype=np.int64)
    jump = np.arange(count)
    begins = np.ones(len(src), dtype=bool)
    begins[1:] = src[1:] != src[:-1]
    head[src[begins]], jump[src[begins]] = letter[begins], dst[begins]
    rank, pointers, length = _dense(head, np.zeros(count, dtype=np.int64)), [jump], 1
    while length < longest:
        rank = _dense(rank, rank[jump])
        jump = jump[jump]
        pointers.append(jump)
        length *= 2
    # The full ranks choose among the arcs of each node.
    order = np.lexsort((rank[dst], letter, src))
    chosen = order[begins]
    if len(chosen) and not np.array_equal(dst[chosen], pointers[0][src[chosen]]):
        raise AssertionError("two arcs of a node share a letter")
    return head, pointers


def read_paths(head: np.ndarray, pointers: list[np.ndarray], roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root number, node, letter) along the least way of each root, in order."""
    # Lengths by the largest jumps first that do not pass the end.
    at, length = roots.copy(), np.zeros(len(roots), dtype=np.int64)
    for k in range(len(pointers) - 1, -1, -1):
        # A jump is whole if the node before its goal still has a letter; so go on while the goal has one.
        goal = pointers[k][at]
        on = head[goal] > 0
        at, length = np.where(on, goal, at), length + np.where(on, 1 << k, 0)
    length += head[at] > 0
    owner = np.repeat(np.arange(len(roots)), length)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    node = roots[owner]
    for k in range(len(pointers)):
        node = np.where(place >> k & 1 > 0, pointers[k][node], node)
    return owner, node, head[node]


def repair(initial: np.ndarray, fault: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple[bytes, bytes]]]:
    """Cost of each conversation, and the letters of its audit with the state after each."""
    first = np.cumsum(size) - size
    conv = np.repeat(np.arange(len(size)), size)
    left = costs(initial, fault, first, size)
    arcs = optimal_arcs(left, initial, fault, conv)
    head, pointers = rank_paths(*arcs, 4 * len(left), int(3 * size.max(initial=0) + 4))
    begin = first + np.arange(len(size))
    owner, node, letter = read_paths(head, pointers, 4 * begin)
    cut = np.searchsorted(owner, np.arange(1, len(size)))
    split = lambda v: [x.tobytes() for x in np.split(v.astype(np.uint8), cut)]
    return left[begin, START], list(zip(split(letter), split(pointers[0][node] % 4)))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `n`, the times that a row occurs: 0 for dropped rows. Nulls become one space, but null turns and ids stay null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_lot") == 1, F.lit("")).when(F.col("_lot") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    marked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("_role"), blank("text").alias("_text"), lot.alias("_lot"))
    return marked.select("conv_id", "turn", F.when(F.col("_lot") == 4, F.lit("user")).otherwise(F.col("_role")).alias("role"), text.alias("text"),
                         F.when(F.col("_lot") == 0, 0).when(F.col("_lot") == 3, 2).otherwise(1).alias("n"))


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows for `repaired` as they are."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text"), F.lit(1).alias("n"))


def _light_and_full(rows: DataFrame) -> DataFrame:
    """Each row twice: first what the repair is decided by, without its text, then with it."""
    letter, end = F.substring("role", 1, 1), F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    initial = F.lit(len(LETTERS))
    for k, x in enumerate(LETTERS):
        initial = F.when(letter == x, F.lit(k)).otherwise(initial)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), GOOD).otherwise(TRUNCATED)
    known = rows.select("conv_id", "turn", "role", "text", "n", initial.alias("initial"), fault.alias("fault"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    twice = known.withColumn("full", F.explode(F.array(F.lit(0), F.lit(1))))
    return twice.withColumn("text", F.when(F.col("full") == 1, F.col("text"))).select("full", "conv_id", "turn", "role", "text", "n", "initial", "fault", "digest")


_FOUND = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string,"
          " turns array<struct<role: string, text: string>>")
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
#: Pairs of neighbouring role initials that may stand, as numbers of LETTERS.
LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Light:
    """A conversation's rows without their texts, as they arrive in order."""

    def __init__(self, conv_id: int | None):
        self.id, self.faults, self.initials, self.seen = conv_id, [], [], set()
        self.turns, self.lowest, self.highest, self.illegal = 0, None, None, 0

    def add(self, turn: int | None, role: str, n: int, initial: int, fault: int, digest: bytes) -> None:
        for _ in range(n):
            if turn is not None and turn != self.highest:
                # Turns come in ascending order.
                self.turns += 1
                self.lowest, self.highest = turn if self.lowest is None else self.lowest, turn
            self.illegal += bool(self.initials) and (self.initials[-1], initial) not in LEGAL
            self.faults.append(DUPLICATE if fault != BLANK and (role, digest) in self.seen else fault)
            self.initials.append(initial)
            self.seen.add((role, digest))

    def measures(self) -> tuple:
        kinds = [self.faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
        return self.id, self.highest - self.lowest + 1 - self.turns if self.turns else 0, *kinds, self.illegal


def _decide(group: list[_Light]) -> list[tuple]:
    flat = lambda name: np.array([x for c in group for x in getattr(c, name)], dtype=np.int64)
    cost, ways = repair(flat("initials"), flat("faults"), np.array([len(c.faults) for c in group], dtype=np.int64))
    return [(c.measures(), int(k), *way) for c, k, way in zip(group, cost, ways)]


class _Writer:
    """Applies a conversation's edits to its rows as they arrive; holds no text unless `whole`."""

    def __init__(self, measures: tuple, cost: int, letters: bytes, states: bytes, whole: bool):
        self.measures, self.cost, self.letters, self.states, self.at = measures, cost, letters, states, 0
        self.digest, self.any, self.turns = hashlib.sha256(), False, [] if whole else None

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True
        if self.turns is not None:
            self.turns.append({"role": role, "text": text})

    def inserted(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == ord("I"):
            self.put(NAMES[self.states[self.at]], "")
            self.at += 1

    def add(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.inserted()
            mark, state = self.letters[self.at], self.states[self.at]
            self.at += 1
            if mark != ord("D"):
                self.put(NAMES[state] if mark == ord("R") else role, text)

    def row(self) -> tuple:
        self.inserted()
        return (*self.measures, self.cost, self.letters.decode(), self.digest.hexdigest(), self.turns)


def _repaired(whole: bool):
    names = [x.split()[0] for x in _FOUND.split(", ")[:9]] + ["turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[_Light] = []
        held, ready, now, out = 0, [], None, []
        write = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=names)
        for batch in batches:
            for full, conv, turn, role, text, n, initial, fault, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if not full:
                    if not group or group[-1].id != conv:
                        if held >= BATCH:
                            ready += _decide(group)
                            group, held = [], 0
                        group.append(_Light(conv))
                    group[-1].add(turn, role, n, initial, fault, digest)
                    held += n
                    continue
                if group:
                    ready += _decide(group)
                    group = []
                    # The full rows follow in the same order; the next conversation is taken from the end.
                    ready.reverse()
                if now is None or now.measures[0] != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Writer(*ready.pop(), whole)
                    if len(out) >= 1000:
                        yield write(out)
                        out = []
                now.add(role, text, n)
        if now is not None:
            out.append(now.row())
        if out:
            yield write(out)

    return run


def repaired(rows: DataFrame, whole: bool = True) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, n): its faults, cost, audit and digest, and with `whole` its repaired turns."""
    order = ["full", F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    found = _light_and_full(rows).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repaired(whole), _FOUND)
    return found if whole else found.drop("turns")
