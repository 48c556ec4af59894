"""Near copies of the pipeline against brute force over five-word shingles."""

import itertools
from collections import Counter

import corpus_pipeline
from kinepair.llm import near_copies, simhash
from pyspark.sql import functions as F

from odd_rows import empty_documents, lowered, odd_documents


def by_hand(rows):
    """(id, text) that stay: the first of each component of texts with similarity of 0.8."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is None, d[0] or 0))
    words = [lowered(t) for _, t in docs]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(docs)))

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    pairs = 0
    for a, b in itertools.combinations(range(len(docs)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) > 0:
            pairs += sets[a] != sets[b]
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {docs[k] for k in range(len(docs)) if root(k) == k}, pairs


def changed(text, places):
    words = text.split()
    for p in places:
        words[p] = f"new{p}"
    return " ".join(words)


def test_stage_loses_no_pair(spark, sf_dir):
    base = [" ".join(f"d{d}w{i}" for i in range(100)) for d in range(6)]
    texts = [changed(t, range(9, 9 + 11 * k, 11)) for t in base for k in range(4)]
    made = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True).unionByName(made, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, pairs = by_hand(rows)
    assert pairs >= 12
    kept = corpus_pipeline.near(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    # Of texts with the same id in a component, the digest decides; none has both here but by whole repeats.
    assert set(got) == want
    # Whole repeats are one document, of which one row stays.
    assert Counter(got) == Counter(want)
    assert corpus_pipeline.near(spark, empty_documents(spark), sf_dir).count() == 0


def test_null_ids_and_a_large_group(spark, sf_dir):
    # 300 copies with one word changed each, a third without id, beside clean rows without id.
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(None if i % 3 == 0 else i, changed(base, [i % 80]) + f" end{i}") for i in range(300)] + [(None, " ".join(f"c{n}x{i}" for i in range(30))) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, sf_dir).collect())
    assert got == Counter([rows[1], *rows[300:]])
    assert near_copies.near_groups(docs).count() == 320


def test_fingerprint_survivors_by_row(spark):
    # A copy without id of document 1, beside clean rows without id; id 7 with a copy and with a clean text.
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (None, text + " "), (7, text + "  "), (7, "clean of seven in its own words"), (None, "one clean text without an id"), (None, "quite another clean text, no id")]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([rows[0], *rows[3:]])


def test_fingerprints_link_copies_first(spark):
    # Copies with one word changed, whose fingerprints differ by two bits at most, beside another text.
    base = " ".join(f"w{i}" for i in range(40000))
    texts = [base, *[changed(base, [k]) for k in (5, 9000, 25000)], " ".join(f"c{i}" for i in range(40000))]
    found = [near_copies.shingles(t.encode()) for t in texts]
    prints = [simhash.majority(s) for s in found]
    want = {tuple(sorted((near_copies.set_key(found[a]), near_copies.set_key(found[b])))) for a, b in itertools.combinations(range(5), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2}
    assert len(want) > 2
    rows = [(near_copies.set_key(s), p - (1 << 64) if p >> 63 else p) for s, p in zip(found, prints)]
    pairs = near_copies.fingerprint_pairs(spark.createDataFrame(rows, "set binary, fp long"))
    parent = {bytes(r[0]): bytes(r[0]) for r in rows}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in pairs.collect():
        a, b = sorted((bytes(r["a"]), bytes(r["b"])))
        assert (a, b) in want
        parent[root(b)] = root(a)
    assert all(root(a) == root(b) for a, b in want)


def test_only_texts_of_pairs_are_shingled_again(spark, monkeypatch):
    # One pair among many texts of their own: a round once sent every text to its pairs.
    base = " ".join(f"w{i}" for i in range(60))
    made = [(0, base), (1, changed(base, [30]))] + [(10 + d, " ".join(f"d{d}w{i}" for i in range(30))) for d in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    seen = []
    whole = near_copies._verify

    def counted(pairs, texts):
        seen.append(texts.count())
        return whole(pairs, texts)

    monkeypatch.setattr(near_copies, "_verify", counted)
    keyed = near_copies._keyed
    sent = []

    def kept(wanted):
        run = keyed(wanted)
        sent.append(docs.select("text", F.xxhash64(F.md5(F.col("text").cast("binary")))).mapInArrow(run, "set binary, text binary").count())
        return run

    monkeypatch.setattr(near_copies, "_keyed", kept)
    assert near_copies.survivors(docs).count() == 301
    assert max(seen) == 2 and max(sent) < 20
