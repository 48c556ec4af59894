"""Conversation repair against an exhaustive search over edit texts."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from kinepair.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, digest string, full int"


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def search(rows):
    """Cheapest edits by a queue ordered by cost and letters; returns (cost, audit, repaired rows)."""
    seen, kinds = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, out = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out), kinds
        # What is possible later depends on the end of the roles only.
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))

        def go(price, letter, step, role=None, text=None):
            more = roles + (role[:1] or "-" if role is not None else "")
            if re.fullmatch("s?(ua)*u?", more):
                heapq.heappush(queue, (cost + price, audit + letter, i + step, more, out if role is None else (*out, (role, text))))

        for role in ("user", "assistant"):
            go(2, "I", 0, role, "")
        if i < len(rows):
            go(3, "D", 1)
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                go(more, "K", 1, *rows[i])
                for role in ("user", "assistant"):
                    go(2 + more, "R", 1, role, rows[i][1])


def by_hand(rows):
    out, after = [], damaged_by_hand(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, fixed, kinds = search([r[2:] for r in mine])
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(kinds.count, ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(), fixed))
    return sorted(out, key=str)


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, "z", 9) for r in rows], SCHEMA)
    got = [(*r[:9], [tuple(t) for t in r[9]]) for r in cr.repaired(cr.damaged(docs)).collect()]
    assert sorted(got, key=str) == by_hand(rows)
    return got


def test_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert any("I" in g[7] for g in compare(spark, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        for k in range(rng.randint(1, 14)):
            rows.append((conv if conv else None, rng.choice([None, k, k, k, rng.randint(-3, 5)]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "answer"]),
                         rng.choice([None, "", " \n", "Yes.", "Why?", "open", f"text {rng.randint(0, 9)}.", "é… end", "x" * 50])))
    compare(spark, rows + rows[:20])


def test_long_conversation_beside_short_ones(spark, monkeypatch):
    monkeypatch.setattr(cr, "BATCH", 50)
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant"]), rng.choice([f"t{k}.", f"t{k}", "same."])) for k in range(700)]
    rows += [(100 + k, 0, "user", "Hello.") for k in range(60)] + [(100 + k, 1, "assistant", "y" * 3000 + "!") for k in range(60)]
    compare(spark, rows)


def test_paths_read_by_doubled_pointers():
    # Least text by hand on a small graph: ties in the first letters are told apart later.
    src, letter, dst = np.array([0, 0, 1, 2, 3]), np.array([66, 65, 65, 67, 66]), np.array([1, 2, 3, 4, 4])
    head, pointers = cr.rank_paths(src, letter, dst, 5, 8)
    owner, node, letters = cr.read_paths(head, pointers, np.array([0, 1, 4]))
    assert [letters[owner == k].tolist() for k in range(3)] == [[65, 67], [65, 66], []] and node.tolist() == [0, 2, 1, 3]


def test_undamaged_and_empty(spark):
    docs = spark.createDataFrame([(1, 0, "system", "Be kind.", "z", 1), (1, 1, "user", "Hi.", "z", 1), (1, 2, "assistant", "Hello!", "z", 1)], SCHEMA)
    got = cr.repaired(cr.undamaged(docs)).first()
    assert (got["cost"], got["audit"], got["gaps"]) == (0, "KKK", 0) and [t["role"] for t in got["turns"]] == ["system", "user", "assistant"]
    assert cr.repaired(cr.damaged(docs.limit(0))).count() == 0
