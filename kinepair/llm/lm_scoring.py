"""Log-likelihood of whole documents under a gated recurrent language model learned from the corpus.

Word counts are taken over all training documents. The most frequent words are symbols of
their own; every other word belongs to one of BUCKETS rare symbols by its last three bytes and, within it, has the
share of its count (plus a half, and one such half for all words never seen), so every word of a text gets its probability. The
network (see `gru`) models the symbols. All documents are read once into symbols, which are written; training and scoring read these. The network is learned in SLICES rounds; in each, one slice
of these documents, all of which are in a slice, is dealt to tasks of about TASK_TOKENS, every task trains from the same weights and the same sums of squared
gradients, and both are averaged by the symbols seen. Rates fall from round to round, so no single slice decides. What is learned from thus grows with the input, and no task or driver holds more than its share.

Counts of up to HEAD frequent words travel with the job; the others, which are most words but few occurrences, are
looked up by a join.

Defined results: a null or empty text is scored as its end alone; a very long text is read and scored whole, and in training its last steps alone weigh little; repeated rows are scored each; a null id counts as
the empty string in the split; an empty table gives an empty result; without training documents every symbol is equally likely; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.llm import gru, phrases
from kinepair.llm.common import Shipped
from kinepair.sources.staging import discard, staged, staged_with

HELD_OUT, FOLDS = 1, 5
SYMBOLS, BUCKETS, CLASSES, HIDDEN = 2048, 512, 32, 16
#: Words whose counts are sent along: at most so many.
HEAD = 300_000
SLICES, TASK_TOKENS = 16, 1_200_000
#: First rate of the steps, and the rounds after which it is half of that.
RATE, SLOWING = 0.08, 16
#: Rows read together.
RUN = 1024
_SPACES = np.zeros(256, dtype=np.uint8)
_SPACES[[0x20, *range(0x09, 0x0E)]] = 1
#: Weights that are averaged in one piece.
PART = 4096
END = b"\n"


def tokens(text: bytes | None) -> list[bytes]:
    """Words, lower-cased in A-Z, and the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def fold(column: str = "doc_id") -> Column:
    """Fold of a document; HELD_OUT is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _texts(batch: pa.RecordBatch, column: int = 0) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(map(bucket, found), pa.int32()), pa.array(found.values(), pa.int64())], names=["word", "bucket", "n"])
        found.clear()
        return out

    for batch in batches:
        for text in _texts(batch):
            found.update(tokens(text))
            if len(found) > 250_000:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, bucket, n) of all training documents, combined per task before the shuffle; written."""
    counted = docs.where(fold() != HELD_OUT).select("text").mapInArrow(_count, "word binary, bucket int, n long")
    return staged(counted.groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")), "word-counts")


class Lexicon:
    """Frequent words with their counts and symbols, totals of the rare buckets and of the corpus."""

    def __init__(self, counts: DataFrame):
        # Words above a count such that at most HEAD remain: found on a histogram of logarithmic steps, at most a few hundred rows.
        step = F.floor(F.log2("n") * 8).cast("int")
        sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
        self.total, self.words = sum(r["n"] for r in sizes), sum(r["words"] for r in sizes)
        held, least = 0, None
        for r in sorted(sizes, key=lambda r: -r["step"]):
            held += r["words"]
            if held > HEAD:
                break
            least = r["step"]
        # The end is always among them.
        head = counts.where((step >= least if least is not None else F.lit(False)) | (F.col("word") == F.lit(END))).select("word", "n").toPandas()
        pairs = sorted(zip(head["word"].map(bytes), head["n"].tolist()), key=lambda x: (-x[1], x[0]))
        own = [END, *[w for w, _ in pairs if w != END][:SYMBOLS - BUCKETS - 1]]
        self.rank = {w: i for i, (w, _) in enumerate(pairs)}
        self.n = np.array([n for _, n in pairs] + [0], dtype=np.float64)
        n_of = dict(pairs)
        # Totals of rare buckets: of all words without own symbols.
        chosen = pickle.dumps(frozenset(own))

        def rare(batches):
            mine, size, kinds = pickle.loads(chosen), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
            for batch in batches:
                keep = np.array([w not in mine for w in batch.column(0).to_pylist()], dtype=bool)
                b, n = batch.column(1).to_numpy()[keep], batch.column(2).to_numpy()[keep]
                size += np.bincount(b, weights=n, minlength=BUCKETS).astype(np.int64)
                kinds += np.bincount(b, minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS), pa.int32()), pa.array(size), pa.array(kinds)], names=["bucket", "n", "words"])

        rows = counts.select("word", "bucket", "n").mapInArrow(rare, "bucket int, n long, words long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
        size, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for r in rows:
            size[r["bucket"]], kinds[r["bucket"]] = r["n"], r["words"]
        self.rare_log = np.log10(size + 0.5 * (kinds + 1))
        # Symbols by falling frequency, so that classes are runs of like frequency.
        counts_of = np.zeros(SYMBOLS)
        counts_of[:len(own)] = [n_of.get(w, 0) for w in own]
        counts_of[SYMBOLS - BUCKETS:] = size
        order = np.argsort(-counts_of, kind="stable")
        place = np.empty(SYMBOLS, dtype=np.int64)
        place[order] = np.arange(SYMBOLS)
        self.frequency, self.rare_symbol = counts_of[order], place[SYMBOLS - BUCKETS:]
        # Per frequent word: its symbol and, for a rare one, its bucket (else -1).
        known = {w: i for i, w in enumerate(own)}
        self.word_bucket = np.array([-1 if w in known else bucket(w) for w, _ in pairs] + [-1], dtype=np.int64)
        self.symbol = np.array([place[known[w]] if w in known else place[SYMBOLS - BUCKETS + bucket(w)] for w, _ in pairs] + [0], dtype=np.int64)
        self.end = int(place[0])

    def index(self) -> None:
        """Codes of the frequent words in order, for `read`."""
        words = list(self.rank)
        self.words = words
        code = _coded([w for w in words if w != END])[3] if len(words) > 1 else np.zeros(0, dtype=np.uint64)
        of = np.array([self.rank[w] for w in words if w != END], dtype=np.int64)
        order = np.argsort(code)
        self.codes, self.at = code[order], of[order]
        self.logs = np.log10(self.n + 0.5)

    def read(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], dict[str, np.ndarray], tuple[np.ndarray, list[bytes], np.ndarray]]:
        """Symbols of each text, what is known of it without the network, and the words to be looked up as (text, word, times)."""
        if not hasattr(self, "codes"):
            self.index()
        low, starts, ends, code, owner = _coded(texts)
        kinds, first, of = np.unique(code, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.codes, kinds), max(0, len(self.codes) - 1))
        hit = self.codes[near] == kinds if len(self.codes) else np.zeros(len(kinds), dtype=bool)
        at = np.where(hit, self.at[near] if len(self.codes) else -1, -1)
        bucket_of, tail = np.empty(len(kinds), dtype=np.int64), {}
        # Codes only propose; the bytes decide.
        for k, (s, e, i) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), at.tolist())):
            word = low[s:e]
            if i >= 0 and self.words[i] != word:
                i = self.rank.get(word, -1)
                at[k] = i
            if i < 0:
                bucket_of[k], tail[k] = zlib.crc32(word[-3:]) % BUCKETS, word
        known = at >= 0
        bucket_of[known] = self.word_bucket[at[known]]
        symbol_of = np.where(known, self.symbol[at], self.rare_symbol[np.maximum(bucket_of, 0)])
        rare = bucket_of >= 0
        base_of = np.where(known, self.logs[at], 0.0)
        rare_of = np.where(rare, np.where(known, self.logs[at], 0.0) - self.rare_log[np.maximum(bucket_of, 0)], 0.0)
        add = lambda v: np.bincount(owner, weights=v[of], minlength=len(texts))
        n = np.bincount(owner, minlength=len(texts))
        end = self.rank.get(END, -1)
        facts = {"n_tokens": n + 1, "n_known": add(known.astype(np.float64)).astype(np.int64) + (end >= 0),
                 "base": add(base_of) + self.logs[end], "rare": add(rare_of)}
        # Each text's symbols are followed by the end.
        flat = np.full(len(of) + len(texts), self.end, dtype=np.int64)
        flat[np.arange(len(of)) + owner] = symbol_of[of]
        unknown = ~known[of]
        pair, times = np.unique(owner[unknown] * max(1, len(kinds)) + of[unknown], return_counts=True)
        return np.split(flat, np.cumsum(n + 1)[:-1]), facts, (pair // max(1, len(kinds)), [tail[k] for k in (pair % max(1, len(kinds))).tolist()], times)


def _coded(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, and start, end, code and text of each word."""
    joined = b"\n".join([*(t or b"" for t in texts), b""])
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    starts, ends, code, _ = phrases.find_words(np.frombuffer(joined, dtype=np.uint8), 1, _SPACES)
    return joined.lower(), starts, ends, code, np.searchsorted(bounds, starts, side="right")


#: Folders of the coded table besides those of the slices: documents that are not learned from, and words to be looked up.
APART, TAIL = -1, -2
_CODED = "slot int, key long, symbols binary, row long, doc_id long, n_tokens long, n_known long, base double, rare double, word binary, times long"
_NAMES = [x.split()[0] for x in _CODED.split(", ")]
_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())


def _read_task(lexicon: Shipped):
    """Documents as 16-bit symbols with what is known of them, and apart from them their words that the lexicon lacks."""

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _KINDS)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.get()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            slots, keys, ids = (batch.column(k).to_pylist() for k in range(3))
            texts = _texts(batch, 3)
            for at in range(0, len(texts), RUN):
                found, facts, unknown = words.read(texts[at:at + RUN])
                end = at + len(found)
                yield rows(len(found), slot=slots[at:end], key=keys[at:end], symbols=[x.astype(np.uint16).tobytes() for x in found], row=row + np.arange(at, end), doc_id=ids[at:end], **facts)
                owner, tail, times = unknown or (None, [], None)
                if tail:
                    yield rows(len(tail), slot=np.full(len(tail), TAIL), row=row + at + owner, word=tail, times=times)
            row += len(texts)

    return run


def coded_table(docs: DataFrame, lexicon: Shipped) -> tuple[DataFrame, list[int]]:
    """The corpus as symbols, in a folder for each slice of the training documents and for APART and TAIL, and the bytes of each slice. Texts are read for this once."""
    slot = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(SLICES)).cast("int")
    rows = docs.select(F.when(fold() != HELD_OUT, slot).otherwise(APART).alias("slot"), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long"), "text")
    read = rows.mapInArrow(_read_task(lexicon), _CODED)
    sizes = [F.sum(F.when(F.col("slot") == k, F.octet_length("symbols"))).alias(f"s{k}") for k in range(SLICES)]
    coded, found = staged_with(read, "lm-symbols", *sizes, by="slot")
    return coded, [found[f"s{k}"] or 0 for k in range(SLICES)]


def _train_task(params: Shipped, rate: float):
    """Trains weights and step cache on the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [np.frombuffer(x, dtype=np.uint16).astype(np.int64) for batch in batches for x in batch.column(0).to_pylist()]
        if docs:
            both = params.get()
            mine, cache = ({k[len(p):]: v for k, v in both.items() if k.startswith(p)} for p in ("p.", "c."))
            gru.train(mine, docs, cache, rate=rate)
            mine = {**{f"p.{k}": v for k, v in mine.items()}, **{f"c.{k}": v for k, v in cache.items()}}
            seen = float(sum(map(len, docs)))
            for k, v in mine.items():
                for at in range(0, v.size, PART):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{k}:{at}"]), pa.array([seen]), pa.array([v.ravel()[at:at + PART].tobytes()], pa.binary())], names=["part", "seen", "data"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list] = {}
    for batch in batches:
        for part, seen, data in zip(*(c.to_pylist() for c in batch.columns)):
            v = np.frombuffer(data, dtype=np.float32).astype(np.float64) * seen
            if part in total:
                total[part][0] += seen
                total[part][1] += v
            else:
                total[part] = [seen, v]
    for part, (seen, v) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([(v / seen).astype(np.float32).tobytes()], pa.binary())], names=["part", "data"])


def learn(docs: DataFrame, lexicon: Shipped, frequency: np.ndarray) -> gru.Params:
    """Weights learned from the training documents of `docs` alone."""
    coded, sizes = coded_table(docs.where(fold() != HELD_OUT), lexicon)
    params = learn_coded(coded, sizes, frequency)
    discard(coded)
    return params


def learn_coded(coded: DataFrame, sizes: list[int], frequency: np.ndarray) -> gru.Params:
    """Weights after all rounds; the driver holds one set of weights and one of the sums that scale the steps."""
    params = gru.initial(frequency, CLASSES, HIDDEN)
    both = {**{f"p.{k}": v for k, v in params.items()}, **{f"c.{k}": v for k, v in gru.fresh_cache(params).items()}}
    for k in range(SLICES):
        if not sizes[k]:
            continue
        tasks = math.ceil(sizes[k] / 2 / TASK_TOKENS)
        ship = Shipped(coded.sparkSession, both)
        # A slice is a folder of its own, so its documents are read together without a shuffle.
        dealt = coded.where(F.col("slot") == k).select("key", "symbols").coalesce(tasks).sortWithinPartitions("key", "symbols").select("symbols")
        tried = dealt.mapInArrow(_train_task(ship, RATE / (1 + k / SLOWING)), "part string, seen double, data binary")
        for r in tried.repartition(tasks, "part").mapInArrow(_average, "part string, data binary").collect():
            name, at = r["part"].split(":")
            v = np.frombuffer(r["data"], dtype=np.float32)
            both[name].reshape(-1)[int(at):int(at) + len(v)] = v
        ship.data.destroy()
    return {k[2:]: v for k, v in both.items() if k.startswith("p.")}


_SCORES = "row long, doc_id long, n_tokens long, n_known long, base double, score double"


def _score_task(params: Shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = params.get()
        for batch in batches:
            symbols = [np.frombuffer(x, dtype=np.uint16) for x in batch.column(6).to_pylist()]
            if symbols:
                found = gru.score(weights, symbols) / math.log(10) + batch.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found)], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def score(docs: DataFrame, counts: DataFrame | None = None, trained: gru.Params | None = None) -> DataFrame:
    """With the network learned from `docs`, or the one given: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    counts = word_counts(docs) if counts is None else counts
    made = Lexicon(counts)
    total, words = made.total, made.words
    lexicon = Shipped(docs.sparkSession, made)
    coded, sizes = coded_table(docs, lexicon)
    lexicon.data.destroy()
    params = Shipped(docs.sparkSession, learn_coded(coded, sizes, made.frequency) if trained is None else trained)
    whole = coded.where(F.col("slot") >= APART).select("row", "doc_id", "n_tokens", "n_known", "base", "rare", "symbols")
    scores = staged(whole.mapInArrow(_score_task(params), _SCORES), "scores")
    # A word outside the head is at most 1 / HEAD-th of the training tokens, so no key of this join is hot but one unseen in training.
    tail = coded.where(F.col("slot") == TAIL).select("row", "word", "times")
    looked = tail.join(counts.select("word", "n"), "word", "left")
    log = F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    more = looked.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_more"), F.sum(log).alias("log_more"))
    rows = scores.join(more, "row", "left").withColumn("log_more", F.coalesce("log_more", F.lit(0.0)))
    scale = math.log10(total + 0.5 * (words + 1))
    return rows.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
                       F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("log_more") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
                       (F.col("score") + F.col("log_more")).alias("score"))
