"""Phrases against a plain count of all windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinepair.llm import phrases
from tests.llm.odd_rows import empty_documents, odd_documents


def by_hand(rows, least=10, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(b"[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower()):
            words = [w for w in re.split(b"[ \t]+", piece) if w]
            total[lang] += len(words)
            for m in (1, 2, 3):
                counts.update((lang, *words[i:i + m]) for i in range(len(words) - m + 1))
    out = {}
    for (lang, *p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(100 * b >= 50 * a for (v, *q), b in counts.items() if v == lang and len(q) == 3 and b >= least and p in (q[:2], q[1:])):
            continue
        score, k = min((1000000 * a * a // (counts[lang, *p[:k]] * counts[lang, *p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, b" ".join(p), counts[lang, *p[:k]], counts[lang, *p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def compare(docs, **options):
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    got = sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())
    assert got == by_hand(rows, options.get("least", 10), options.get("top", 2000))
    return got


def noise(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "ÉA", "x" * 40, "a.b", "über"] + [f"w{k}" for k in range(30)]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", " ! "]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "en", "de", None, ""])) for _ in range(docs)]


def test_odd_and_random_rows(spark):
    odd = odd_documents(spark)
    rows = noise(1) + [("new york city. " * 30, "en"), ("New York\tcity " * 12, "de"), ("a " * 500, None), ("the of " * 3000, "en")]
    docs = odd.select("text", "lang", "doc_id", "word").unionByName(spark.createDataFrame([(t, v, i, "z") for i, (t, v) in enumerate(rows)], "text string, lang string, doc_id long, word string"))
    got = compare(docs)
    assert {g[0] for g in got} >= {"en", "de", "und"}
    compare(docs, top=3)


def test_small_pieces_give_the_same(spark, monkeypatch):
    for name, value in (("PIECE", 7), ("PENDING", 50), ("CHUNK", 20), ("ROW", 7), ("SLICE", 300), ("PART", 64), ("WORD_BITS", 12), ("FEWEST_BITS", 11), ("MOST_BITS", 11), ("_SUMS", 4)):
        monkeypatch.setattr(phrases, name, value)
    compare(spark.createDataFrame(noise(2, 30), "text string, lang string").repartition(3), least=3)


def test_shared_code_is_seen(spark, monkeypatch):
    honest = phrases.coded

    def poor(lang, text, seed):
        data, starts, ends, code, before = honest(lang, text, seed)
        return data, starts, ends, code % np.uint64(5) + np.uint64(1) if seed == 1 else code, before

    monkeypatch.setattr(phrases, "coded", poor)
    docs = spark.createDataFrame(noise(3, 20), "text string, lang string")
    assert phrases.word_table(docs)[1] == 2
    compare(docs, least=3)


def test_empty(spark):
    assert phrases.collocations(empty_documents(spark)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("one two", "en"), (None, "en"), ("", None)], "text string, lang string")).count() == 0


def test_documents(spark, sf_dir):
    compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@pytest.mark.parametrize("size", [1, 2, 3])
def test_double_array_counts(size):
    rng = np.random.default_rng(size)
    for kinds, n in ((3, 5), (700, 4000), (70_000, 9000)):
        codes = rng.integers(1, 1 << 63, kinds, dtype=np.uint64)
        wanted = np.unique(codes[(rng.random((n, size)) ** 3 * kinds).astype(int)], axis=0)
        trie = phrases.DoubleArray(wanted[rng.permutation(len(wanted))])
        run = codes[(rng.random(20_000) ** 3 * kinds).astype(int)]
        found = Counter(tuple(run[i:i + size].tolist()) for i in range(len(run) - size + 1))
        assert [found[tuple(p)] for p in trie.phrases.tolist()] == trie.count(run).tolist()
        assert len(trie.phrases) == len(wanted)


def test_words_do_not_depend_on_parts(monkeypatch):
    data = np.frombuffer(b"  Alpha beta,gamma\n\nalpha. " + b"y" * 200 + b" BETA", dtype=np.uint8)
    whole = phrases.find_words(data, 1)
    monkeypatch.setattr(phrases, "PART", 5)
    parts = phrases.find_words(data, 1)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert whole[2][0] == whole[2][3] and whole[2][1] == whole[2][5] and whole[3].tolist() == [True, False, True, True, True, False]
    assert len(phrases.coded(pa.array([None, "x"]), pa.array([b"", b"a b"], pa.large_binary()), 1)[3]) == 2
