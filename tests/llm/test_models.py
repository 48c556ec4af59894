"""Language model, SentencePiece, mixing and pipeline against brute force, the model's own library and held-out text."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from kinepair.llm import gru, lm_scoring, mixing, sentence_pieces
from kinepair.llm.common import Shipped
from kinepair.sources.staging import staged
from pyspark.sql import functions as F

from odd_rows import empty_documents, lowered, odd_documents, odd_texts

SPACE = sentence_pieces.SPACE
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)


def small_params(symbols=12, classes=3, hidden=4):
    p = gru.initial(np.arange(symbols, 0, -1).astype(float), classes, hidden)
    rng = np.random.default_rng(1)
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in p.items()}


def score_by_hand(p, doc):
    """One document, one step at a time."""
    hidden, size = p["U"].shape[0], p["w"].shape[1]
    h, before, total = np.zeros(hidden), -1, 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    for s in doc:
        x, u = p["E"][before + 1], h @ p["U"]
        r, z = sig(x[:hidden] + u[:hidden]), sig(x[hidden:2 * hidden] + u[hidden:2 * hidden])
        n = np.tanh(x[2 * hidden:] + r * u[2 * hidden:])
        h = (1 - z) * n + z * h
        k = s // size
        total += math.log(soft(h @ p["C"] + p["c"])[k]) + math.log(soft(h @ p["W"][k] + p["w"][k])[s % size])
        before = s
    return total


def test_state_is_carried_across_windows():
    p, rng = small_params(), np.random.default_rng(2)
    docs = [rng.integers(0, 12, n) for n in (1, 7, 40, 3, 25)]
    assert np.allclose(gru.score(p, docs, lanes=2, length=5), [score_by_hand(p, d) for d in docs], atol=1e-4)


def test_symbol_probabilities_sum_to_one():
    p = small_params()
    assert math.isclose(sum(math.exp(score_by_hand(p, d)) for d in product(range(12), repeat=2)), 1, rel_tol=1e-9)


def test_gradients_by_differences():
    p, rng = small_params(), np.random.default_rng(4)
    docs, seen = [rng.integers(0, 12, n) for n in (6, 4)], {}
    before = {k: v.copy() for k, v in p.items()}
    # One window and a step size that makes the change the gradient itself.
    cache = {k: np.full_like(v, 1e12) for k, v in p.items()}
    gru.train(p, docs, cache, lanes=2, length=8, rate=1e6)
    for k in ("U", "C", "W", "w", "c", "E"):
        at = np.unravel_index(np.argmax(abs(before[k] - p[k])), p[k].shape)
        up, down = ({n: v.copy() for n, v in before.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        want = -(sum(score_by_hand(up, d) for d in docs) - sum(score_by_hand(down, d) for d in docs)) / 2e-4 / 16
        seen[k] = (float((before[k] - p[k])[at]), want)
        assert math.isclose(*seen[k], rel_tol=2e-2, abs_tol=1e-4), seen


def test_lanes_go_on_with_further_documents():
    docs = [np.full(n, k) for k, n in enumerate((3, 9, 1, 4, 4, 2))]
    seen = Counter()
    for block, begins in gru.streams(docs, 2, 5):
        assert block.shape == begins.shape and (block[begins] >= 0).all()
        seen.update(block[block >= 0].tolist())
        seen.update(("start", int(k)) for k in block[begins])
    assert all(seen[k] == len(d) and seen["start", k] == 1 for k, d in enumerate(docs))
    assert sorted(i for lane in gru.dealt([3, 9, 1, 4, 4, 2], 2) for i in lane) == list(range(6))


def test_training_does_not_hang_on_a_last_long_text():
    rng = np.random.default_rng(6)

    def text(n):
        # Symbols that follow each other mostly in a ring, which the network learns.
        return np.cumsum(rng.choice([1, 1, 1, 5], n)) % 12

    docs, held = [text(40) for _ in range(400)], [text(60) for _ in range(20)]
    first = gru.initial(np.ones(12), 3, 8)
    start, losses = gru.score(first, held).sum(), []
    for extra in ([], [text(6000)]):
        p = {k: v.copy() for k, v in first.items()}
        cache = gru.train(p, docs[:200], lanes=32)
        gru.train(p, docs[200:] + extra, cache, lanes=32)
        losses.append(gru.score(p, held).sum())
    assert min(losses) > start * 0.9 and losses[1] > losses[0] * 1.01


def test_whole_score_by_hand(spark, sf_dir):
    """Every part of the score of every document, with the network run one step at a time."""
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 25").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    rows = [(r["doc_id"], (r["text"] or "")[:600]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = lm_scoring.Lexicon(lm_scoring.word_counts(docs))
    params = lm_scoring.learn(docs, Shipped(spark, lexicon), lexicon.frequency)
    wide = {k: v.astype(np.float64) for k, v in params.items()}
    counts = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in [*lowered(t), b"\n"])
    own = [b"\n", *sorted((w for w in counts if w != b"\n"), key=lambda w: (-counts[w], w))][:lm_scoring.SYMBOLS - lm_scoring.BUCKETS]
    rare = [w for w in counts if w not in own]
    sizes = [(sum(counts[w] for w in rare if lm_scoring.bucket(w) == b), sum(lm_scoring.bucket(w) == b for w in rare)) for b in range(lm_scoring.BUCKETS)]
    totals = [counts[w] for w in own] + [0] * (lm_scoring.SYMBOLS - lm_scoring.BUCKETS - len(own)) + [n for n, _ in sizes]
    place = {k: i for i, k in enumerate(np.argsort(-np.array(totals), kind="stable").tolist())}
    got = Counter((r["doc_id"], round(r["score"], 2)) for r in lm_scoring.score(docs, trained=params).collect())
    want = []
    for i, t in rows:
        words, more = [*lowered(t), b"\n"], 0.0
        symbols = []
        for w in words:
            if w in own:
                symbols.append(place[own.index(w)])
            else:
                b = lm_scoring.bucket(w)
                symbols.append(place[lm_scoring.SYMBOLS - lm_scoring.BUCKETS + b])
                more += math.log10(counts[w] + 0.5) - math.log10(sizes[b][0] + 0.5 * (sizes[b][1] + 1))
        want.append((i, score_by_hand(wide, symbols) / math.log(10) + more))
    assert len(want) == sum(got.values())
    for i, s in want:
        assert any(k[0] == i and abs(k[1] - s) < 0.02 + 1e-4 * abs(s) for k in got), (i, s)


def base_by_hand(rows):
    split = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    counts = Counter(w for i, t in rows if not split[i] for w in [*lowered(t), b"\n"])
    total = sum(counts.values())
    scale = math.log10(total + 0.5 * (len(counts) + 1))
    out = defaultdict(list)
    for i, t in rows:
        w = [*lowered(t), b"\n"]
        out[i].append((split[i], len(w), sum(x in counts for x in w), total, sum(math.log10(counts[x] + 0.5) - scale for x in w)))
    return out


@pytest.mark.parametrize("head", [0, 300_000])
def test_scores_with_and_without_head(spark, sf_dir, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    want = base_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = lm_scoring.score(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and math.isclose(r["base_score"], w[4], rel_tol=1e-9) for w in want[r["doc_id"]])
        assert r["score"] < 0
    assert lm_scoring.score(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_model_beats_base_on_held_out_text(spark, sf):
    got = lm_scoring.score(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_pieces_equal_the_library(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "HEAD", 2000)
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    want = Counter((r["doc_id"], tuple(LIBRARY.encode(r["text"] or ""))) for r in docs.collect())
    encoded = staged(sentence_pieces.encode(docs), "encoded")
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    assert encoded.where("not round_trip").count() == sum("▁" in (t or "") for t in odd_texts())
    back = Counter(tuple(r) for r in sentence_pieces.decode(encoded).collect())
    assert back == Counter((r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in docs.collect())
    assert sentence_pieces.encode(empty_documents(spark)).count() == 0


def test_words_rebuild_the_text():
    for text in odd_texts():
        words = [w for w in sentence_pieces.words_of(text or "") if w]
        assert all(SPACE not in w.lstrip(SPACE) for w in words)
        assert "".join(words) == ("▁" + text.replace(" ", "▁") if text else "")


def test_overtaken_merges_are_queued(spark):
    # Joining b and c comes first and rules out ab; abc is better than bc and is possible only after it.
    pieces = {"a": (1, 0.0), "b": (2, 0.0), "c": (3, 0.0), "abc": (4, -1.0), "bc": (5, -2.0), "abcd": (6, -3.0), "d": (7, 0.0)}
    model = sentence_pieces.Model(pieces, None)
    words = spark.createDataFrame([(w, 1) for w in ("abc", "abcd", "bcd", "xa", "d" * 80)], "word string, n long")
    got = {r["word"]: r["places"] for r in sentence_pieces.dictionary(words, model).collect()}
    assert got["abc"] is None and got["abcd"] is None and got["bcd"] == 0b1101 and "xa" not in got and "d" * 80 not in got
    assert [model.encode_word(w, got.get(w)) for w in ("abc", "abcd", "bcd", "xa", "d" * 80)] == [[4], [6], [5, 7], [0, 1], [7] * 80]


def test_viterbi_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    pieces = {c: (i + 1, -5.0 - i) for i, c in enumerate("abcd")}
    for k in range(25):
        pieces.setdefault("".join(rng.choice(list("abcd"), rng.integers(2, 5))), (10 + k, -float(rng.random() * 8) - 1))
    model = sentence_pieces.Model(pieces, None, kind="unigram")
    texts = ["".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(60)]
    words = spark.createDataFrame([(w, 1) for w in set(texts)], "word string, n long")

    def best(w):
        options = [(0.0, [])] if not w else []
        for e in range(1, len(w) + 1):
            if w[:e] in pieces:
                s, ids = best(w[e:])
                options.append((s + pieces[w[:e]][1], [pieces[w[:e]][0], *ids]))
        return max(options)

    score = {i: s for i, s in pieces.values()}
    for r in sentence_pieces.cut_by_viterbi(words, model).collect():
        assert math.isclose(sum(score[i] for i in model.encode_word(r["word"], r["places"])), best(r["word"])[0], rel_tol=1e-9)
        assert math.isclose(sum(score[i] for i in model.viterbi(r["word"])), best(r["word"])[0], rel_tol=1e-9)


def fill(children, budget):
    """Shares by repeated redistribution, in fractions."""
    from fractions import Fraction

    given, open_ = dict.fromkeys(children, Fraction(0)), {k for k, (c, _) in children.items() if c}
    left = Fraction(budget)
    while open_ and left > 0:
        weight = sum(children[k][1] for k in open_)
        full = {k for k in open_ if given[k] + left * children[k][1] / weight >= children[k][0]}
        if not full:
            for k in open_:
                given[k] += left * children[k][1] / weight
            break
        # Fill the ones that are first to be full, then share again what they left.
        first = min(full, key=lambda k: (children[k][0] - given[k]) / children[k][1])
        part = (children[first][0] - given[first]) / children[first][1]
        for k in open_:
            given[k] += part * children[k][1]
        left -= part * weight
        open_ -= {k for k in open_ if given[k] >= children[k][0]}
    return given


def test_budgets_follow_the_tree(spark):
    rng = np.random.default_rng(6)
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}, "source": {"s1": 5}}
    rows = [(d, la, s, int(rng.integers(0, 400))) for d in "abc" for la in ("en", "de") for s in ("s1", "s2", "s3") if rng.random() < 0.9]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, supply long")
    for budget in (0, 1, 500, 1700, 10**7):
        got = {tuple(r)[:3]: r["given"] for r in mixing.budgets(leaves, budget, weights, 2).collect()}
        total = min(budget, 2 * sum(r[3] for r in rows))
        assert sum(got.values()) == total
        assert all(0 <= got[r[:3]] <= 2 * r[3] for r in rows)
        for level in range(3):
            for parent in {r[:level] for r in rows}:
                mine = [r for r in rows if r[:level] == parent]
                names = {r[level] for r in mine}
                children = {n: (2 * sum(r[3] for r in mine if r[level] == n), weights[mixing.LEVELS[level]].get(n, 1)) for n in names}
                have = {n: sum(got[r[:3]] for r in mine if r[level] == n) for n in names}
                want = fill(children, sum(have.values()))
                assert all(abs(have[n] - want[n]) <= 1 for n in names)


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.select(docs, share_percent=250, max_epochs=2).collect()
    sizes = Counter(r["doc_id"] for r in docs.collect())
    # The empty text with id 1 is alone in a leaf without tokens.
    assert Counter(r["doc_id"] for r in rows) == {k: 2 * n for k, n in sizes.items() if k != 1}
    out = mixing.mixed(docs, share_percent=100)
    assert out.columns == docs.columns
    assert mixing.select(docs, budget=0).count() == 0 == mixing.mixed(docs, budget=0).count() == mixing.select(empty_documents(spark)).count()
    # Without rows that share an id, and so a place in the order, the budget is met to the token.
    part = mixing.select(docs.dropDuplicates(["doc_id"]), budget=300).groupBy("domain", "lang", "source", "epoch").agg(F.sum("used_tokens").alias("u")).agg(F.sum("u")).first()[0]
    assert part == 300


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        if name == "quality_classifier":
            kept = {r["doc_id"] for r in docs.collect()}
            assert len(good & kept) > 0.97 * len(good)
        if name == "exact_dedup":
            assert Counter(r["text"] for r in docs.collect()) == Counter({r["text"] for r in before.collect()})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in last.collect()) == Counter((r["doc_id"], tuple(LIBRARY.encode(r["text"]))) for r in docs.collect())


def test_pipeline_run_and_empty_input(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
