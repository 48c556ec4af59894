"""Quality classifier: support vectors on naive Bayes features.

A text is the set of its n-grams over character classes (letters by case, digits, white space, every ASCII
sign by itself; n up to 3), each with a second indicator for n-grams that are frequent in it, of
indicators for words that repeat, and of its words, word pairs and runs of LETTERS bytes, hashed into SLOTS places each.
Indicators are scaled by their class log-count ratio, the shapes and the wording each by its
length, the wording at WORDING of the weight, as it is much of it; and a linear hinge-loss model is fitted by dual coordinate descent. Margins become
probabilities by a sigmoid fitted on margins of held-out rows.

The fit sees at most `max_rows` labelled documents, chosen by a hash of their id; this is the only bound, and
scoring covers every whole text. The chosen labels are joined by a broadcast of at most that many rows.

Defined results: a null or empty text has no n-grams and is scored by that; labels of an id that disagree
count by majority, ties as 0; null labels are left out; with labels of one class only every score is 1 or 0 accordingly, without labels 0.5; an
empty table gives an empty result; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import operator
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.llm import phrases

#: Labelled documents that a fit uses at most.
MAX_ROWS = 12_000
HELD_OUT, FOLDS = 2, 4
KEEP = 0.7
COST, ROUNDS, SMOOTH, FREQUENT = 1.0, 12, 1.0, 64


def _classes() -> np.ndarray:
    """Class of every byte: 0 lower case and bytes of other letters, 1 upper case, 2 digits, 3 space, 4 line end, then each sign."""
    table = np.zeros(256, dtype=np.int32)
    signs = 5
    for b in range(128):
        c = chr(b)
        if "A" <= c <= "Z":
            table[b] = 1
        elif c.isdigit():
            table[b] = 2
        elif c == "\n":
            table[b] = 4
        elif c.isspace() or not c.isprintable():
            table[b] = 3
        elif not c.isalpha():
            table[b], signs = signs, signs + 1
    return table


CLASSES = _classes()
#: Indicators: n-grams of 64 classes for n = 1, 2, 3, again for frequent ones, then the word indicators.
GRAMS = 64 + 64 ** 2 + 64 ** 3
WORDS = 2 * GRAMS
SHAPES = WORDS + 48
#: Bytes of a letter run, places for each kind of wording, and the weight of all wording.
LETTERS, SLOTS, WORDING = 4, 1 << 16, 0.5
SIZE = SHAPES + 3 * SLOTS
_SPACES = np.zeros(256, dtype=np.uint8)
_SPACES[[0x20, *range(0x09, 0x0E)]] = 1


def _wording(text: bytes) -> list[np.ndarray]:
    """Sorted places of words, word pairs and letter runs."""
    data = np.frombuffer(text, dtype=np.uint8)
    codes = phrases.find_words(data, 1, _SPACES)[2] if len(data) else np.zeros(0, dtype=np.uint64)
    runs = np.zeros(max(0, len(data) - LETTERS + 1), dtype=np.uint64)
    low = phrases._LOWER[data].astype(np.uint64)
    for k in range(LETTERS if len(runs) else 0):
        runs |= low[k:k + len(runs)] << np.uint64(8 * k)
    out = []
    for k, hashes in enumerate((codes, phrases.phrase_key(codes, 2), runs)):
        found = np.zeros(SLOTS, dtype=bool)
        found[phrases.mixed(hashes) >> np.uint64(64 - SLOTS.bit_length() + 1)] = True
        out.append(np.flatnonzero(found) + (SHAPES + k * SLOTS))
    return out


def indicators(text: bytes) -> np.ndarray:
    """Numbers of the indicators that are set, those of the wording last."""
    c = CLASSES[np.frombuffer(text, dtype=np.uint8)]
    out, first = [], 0
    for n in (1, 2, 3):
        if len(c) >= n:
            code = c[:len(c) - n + 1]
            for k in range(1, n):
                code = code * 64 + c[k:len(c) - n + 1 + k]
            seen, count = np.unique(code, return_counts=True)
            out += [seen + first, seen[count * FREQUENT > len(code)] + (first + GRAMS)]
        first += 64 ** n
    words = text.split()
    if words:
        same = sum(map(operator.eq, words, words[1:])) / len(words)
        out.append(np.array([WORDS + int(15 * same), WORDS + 16 + int(15 * len(set(words)) / len(words)), WORDS + 32 + min(15, len(words).bit_length())]))
    out += _wording(text)
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, dtype=np.int32)


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the ratio of an indicator's share in class 1 to that in class 0."""
    shares = []
    for y in (1, 0):
        counts = np.full(SIZE, SMOOTH)
        # Indicators of a row are distinct; rows are added one by one, as all of them together take much memory.
        for r, v in zip(rows, labels):
            if v == y:
                counts[r] += 1
        shares.append(counts / counts.sum())
    return np.log(shares[0] / shares[1])


def scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    values = ratio[row].astype(np.float64)
    cut = int((row < SHAPES).sum())
    for part, weight in ((values[:cut], 1.0), (values[cut:], WORDING)):
        part *= weight / (np.sqrt(part @ part) or 1.0)
    return values


def descend(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights (last one the bias) of the hinge-loss model: each step solves one dual variable exactly.

    Errors of the rarer class weigh more, so that both classes weigh alike.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    bound = COST * 0.5 / share
    w, alpha, rng = np.zeros(SIZE + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)):
            # Values are made anew each time, so only the indicators are held.
            row = rows[i]
            v = scaled(row, ratio)
            gradient = y[i] * (w[row] @ v + w[SIZE]) - 1.0
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[row] += step * v
                w[SIZE] += step
                alpha[i] = new
    return w


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits the labels best, by Newton steps on smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([d @ margins, d.sum()])
        hess = np.array([[h @ (margins * margins) + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def fit(texts: list[bytes], labels: list[int]) -> dict:
    """The model of labelled texts; margins for the sigmoid come from a model that did not see them."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return {"constant": float(y[0]) if len(y) else 0.5}
    rows = []
    while texts:
        rows.append(indicators(texts.pop()))
    rows.reverse()
    part = np.arange(len(rows)) % 3 == 0
    if len(set(y[~part])) == 2 and len(set(y[part])) == 2:
        seen, held = np.flatnonzero(~part), np.flatnonzero(part)
    else:
        seen = held = np.arange(len(rows))
    ratio = log_count_ratio([rows[i] for i in seen], y[seen])
    w = descend([rows[i] for i in seen], ratio, y[seen])
    slope, offset = sigmoid_fit(np.array([w[rows[i]] @ scaled(rows[i], ratio) + w[SIZE] for i in held]), y[held])
    ratio = log_count_ratio(rows, y)
    w = descend(rows, ratio, y)
    return {"ratio": ratio.astype(np.float32), "w": w.astype(np.float32), "slope": slope, "offset": offset}


def score(model: dict, text: bytes) -> float:
    """Probability of label 1."""
    if "constant" in model:
        return model["constant"]
    row = indicators(text)
    margin = float(model["w"][row] @ scaled(row, model["ratio"]) + model["w"][SIZE])
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30))))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        labels += batch.column(1).to_pylist()
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(texts, labels))], pa.binary())})


def fold(column: str = "doc_id") -> Column:
    """Fold of a document; HELD_OUT is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """Fits on at most `max_rows` labelled documents outside the held-out fold, in one task of that bounded size."""
    votes = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.avg(F.col(target).cast("double")).alias("y"))
    chosen = votes.select("doc_id", (F.col("y") > 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    # A fixed order of rows makes the model the same however the input is partitioned.
    fitted = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "y").mapInArrow(_fit_rows, "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else fit([], [])


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; no shuffle."""
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(ship.value, t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows, with all their columns, whose score reaches KEEP; no shuffle."""
    ship, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(ship.value, t or b"") >= KEEP for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
