"""Language id against a plain reading of its definition, and on held-out rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

from kinepair.llm import language_id as li
from kinepair.llm import queries
from tests.llm.odd_rows import empty_documents, odd_documents


def by_hand(rows):
    """(language, score) of each (doc_id, text, lang)."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str("" if i is None else i).encode()) % li.FOLDS != li.HELD_OUT:
            for w in li.WORD.findall((text or "").lower()):
                counts[0, lang][w] += 1
                for n in range(1, li.LONGEST + 1):
                    p = f" {w} " if n > 1 else w
                    counts[n, lang].update(p[k:k + n] for k in range(len(p) - n + 1))
    langs = sorted({lang for _, lang in counts})
    logs = defaultdict(dict)
    for (n, lang), c in counts.items():
        for g, k in c.items():
            if k * (li.KEPT // len(langs)) >= c.total():
                logs[n, g][lang] = math.log10(k / c.total())
    out = []
    for _, text, _ in rows:
        sums, known, words = Counter(), 0, li.WORD.findall((text or "").lower())
        for w in words:
            found = [(0, w)] if (0, w) in logs else []
            for n in range(li.LONGEST, 0, -1):
                p = f" {w} " if n > 1 else w
                found = found or [(n, p[k:k + n]) for k in range(len(p) - n + 1) if (n, p[k:k + n]) in logs]
            known += bool(found)
            for f in found:
                for v in langs:
                    sums[v] += logs[f].get(v, li.PENALTY) / len(found)
        if not words or not langs:
            out.append((li.UNKNOWN, 0.0))
        elif not known:
            out.append((min(langs, key=lambda v: (-counts[0, v].total(), v)), 1 / len(langs)))
        else:
            mean = {v: round(sums[v] / known, 9) for v in langs}
            best = min(langs, key=lambda v: (-mean[v], v))
            out.append((best, 1 / sum(10 ** (mean[v] - mean[best]) for v in langs)))
    return out


def compare(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in li.predict(docs, li.train(docs)).collect())
    want = sorted((str(r[0]), lang, s) for r, (lang, s) in zip(rows, by_hand(rows)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_equals_definition(spark, sf_dir):
    compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_rows(spark):
    odd = odd_documents(spark)
    compare(odd)
    texts = ["the cat", "le chat", "zzz", None, "123", "ÄÖ ß é", "א", "der Hund", "the the the"]
    compare(spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, ["en", "fr", None, "en", "de", "de", None, "de", "en"]))], odd.schema.simpleString()[7:-1].split(",lang")[0] + ", lang string"))


def test_long_text_is_read_in_runs(spark, monkeypatch):
    monkeypatch.setattr(li, "CELLS", 10)
    model = li.Model(li.shares(spark.createDataFrame([(0, "ab cd ef", "x"), (1, "gh ij kl", "y")], "doc_id long, text string, lang string")).toPandas())
    text = ("ab gh " * 3000 + "cd").encode()
    assert model.classify([text, b"", text])[0] == ["x", li.UNKNOWN, "x"]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(0, "some words", None), (1, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in li.predict(docs, li.train(docs)).collect()} == {(li.UNKNOWN, 0.0)}
    empty = empty_documents(spark)
    assert li.predict(empty, li.train(empty)).count() == 0


def test_model_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(li, "KEPT", 40)
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(i, i + 60)), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    kept = li.shares(docs).groupBy("level").count().collect()
    assert all(r["count"] <= 40 for r in kept)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got.lang_pred == got.lang).mean() > 0.99 and got.score.between(0, 1).all()
