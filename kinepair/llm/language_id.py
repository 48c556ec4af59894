"""Language of whole texts by words first and character n-grams for words never seen.

A word is a letter with the letters and marks that follow it, in lower case. For each language the model holds the logarithm of the
share of frequent words and, for each n up to LONGEST, of frequent n-grams within words (a blank marks both ends of a word where n > 1). A word known to some language
is scored by its shares, PENALTY where a language does not know it. A word known to none is scored by the mean over its
known n-grams of the largest n of which it has any; one without any is left out. The language with the largest mean over the words of the text is
taken; the score is its share among the powers of ten of the means.

All training documents are counted. What is kept of the counts is a share, not a number of documents: an entry stays if it
makes up one KEPT / languages-th of its language at least, so a level of the model has at most KEPT entries whatever the
size of the corpus, and may be broadcast.

Defined results: a null text and one without letters is `und`, score 0, as is every text if nothing was learned; a text without any known n-gram
goes to the language with most words in training, with an equal share as score; ties go to the first language in alphabetical order; a null lang is not learned from;
a null id counts as the empty string in the split; repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.llm.common import Shipped
from kinepair.sources.staging import staged

HELD_OUT, FOLDS = 2, 4
LONGEST, KEPT, PENALTY = 4, 200_000, -7.0
UNKNOWN = "und"
#: Languages whose totals are broadcast: one row each for every level.
FEW = 10_000
#: Cells of the table of words by languages that a task holds at a time.
CELLS = 4_000_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: bytes | None) -> list[str]:
    return WORD.findall((text or b"").decode("utf-8", "replace").lower())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def fold(column: str = "doc_id") -> Column:
    """Fold of a document; HELD_OUT is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter[str]] = defaultdict(Counter)

    def flush():
        for lang, n in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), dtype=np.int64))), pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["lang", "word", "n"])
        found.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            found[lang].update(words(text))
            if sum(map(len, found.values())) > 250_000:
                yield from flush()
    yield from flush()


def shares(docs: DataFrame) -> DataFrame:
    """(level, lang, gram, n, total) of the entries kept; level 0 are words, level n are n-grams."""
    learned = docs.where(F.col("lang").isNotNull() & (fold() != HELD_OUT)).select(F.col("lang").cast("string"), "text")
    counted = staged(learned.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def level(n: int) -> DataFrame:
        text = padded if n > 1 else F.col("word")
        # A padded word has two characters more, so every sequence of places is ascending.
        places = F.sequence(F.lit(1), F.char_length(text) - (n - 1))
        usable = counted.where(F.char_length(text) >= n)
        each = usable.select("lang", "n", F.explode(F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).alias("gram"))
        return each.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(F.lit(n).alias("level"), "lang", "gram", "n")

    entries = counted.select(F.lit(0).alias("level"), "lang", F.col("word").alias("gram"), "n")
    for n in range(1, LONGEST + 1):
        entries = entries.unionByName(level(n))
    entries = staged(entries, "lang-entries")
    totals = entries.groupBy("level", "lang").agg(F.sum("n").alias("total"))
    languages = max(1, totals.select("lang").distinct().count())
    # A language may hold most entries, so its few totals go to all tasks as long as there are few languages.
    sized = F.broadcast(totals) if languages <= FEW else totals
    return entries.join(sized, ["level", "lang"]).where(F.col("n") * F.lit(KEPT // languages) >= F.col("total"))


class Model:
    """Shares by level and gram; the rows of all levels lie in one table of (language, value) entries."""

    def __init__(self, kept: pd.DataFrame):
        kept = kept.sort_values(["level", "gram", "lang"])
        self.langs = sorted(set(kept["lang"]))
        at = {v: i for i, v in enumerate(self.langs)}
        sizes = kept[kept["level"] == 0].drop_duplicates("lang").set_index("lang")["total"].to_dict()
        self.common = int(np.argmax([sizes[v] for v in self.langs])) if self.langs else 0
        self.lang = kept["lang"].map(at).to_numpy(dtype=np.int64)
        # Above the penalty, which every word pays in every language.
        self.value = np.log10(kept["n"].to_numpy(dtype=np.float64) / kept["total"].to_numpy(dtype=np.float64)) - PENALTY
        level, gram = kept["level"].to_numpy(), kept["gram"].to_numpy()
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (level[1:] != level[:-1]) | (gram[1:] != gram[:-1])
        starts = np.flatnonzero(new)
        self.bounds = np.append(starts, len(kept))
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for i, s in enumerate(starts.tolist()):
            self.rows[level[s]][gram[s]] = i

    def found(self, word: str) -> list[int]:
        """Rows whose mean is the word's."""
        row = self.rows[0].get(word)
        if row is not None:
            return [row]
        for n in range(LONGEST, 0, -1):
            have = [r for r in map(self.rows[n].get, grams(word, n)) if r is not None]
            if have:
                return have
        return []

    def table(self, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of each word by language above the penalty, and whether the word has any."""
        rows = [self.found(w) for w in kinds]
        n = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(n.sum()))
        word, weight = np.repeat(np.arange(len(kinds)), n), np.repeat(1 / np.maximum(n, 1), n)
        size = self.bounds[flat + 1] - self.bounds[flat]
        entry = np.repeat(self.bounds[flat] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(word, size) * len(self.langs) + self.lang[entry]
        values = np.bincount(cell, weights=self.value[entry] * np.repeat(weight, size), minlength=len(kinds) * len(self.langs))
        return values.reshape(len(kinds), len(self.langs)), n > 0

    def classify(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        wide = len(self.langs)
        if not wide:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, known, some = np.zeros((len(texts), wide)), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        step = max(1000, CELLS // wide)

        def add(run: list[str], owner: np.ndarray) -> None:
            code, kinds = pd.factorize(np.array(run, dtype=object))
            values, has = self.table(list(kinds))
            # Occurrences of each kind of word in each text.
            pair, times = np.unique(owner * len(kinds) + code, return_counts=True)
            doc, kind = pair // len(kinds), pair % len(kinds)
            known[:] += np.bincount(doc, weights=times * has[kind], minlength=len(texts))
            for k in range(wide):
                total[:, k] += np.bincount(doc, weights=times * values[kind, k], minlength=len(texts))

        run, owners = [], []
        for i, text in enumerate(texts):
            mine = words(text)
            some[i] = bool(mine)
            for at in range(0, len(mine), step):
                part = mine[at:at + step]
                run += part
                owners.append((i, len(part)))
                if len(run) >= step:
                    add(run, np.repeat(*np.array(owners).T))
                    run, owners = [], []
        if run:
            add(run, np.repeat(*np.array(owners).T))
        # Rounded, so that ties do not hang on the order of the sums.
        mean = np.round(total / np.maximum(known, 1)[:, None], 9)
        best = np.where(known > 0, mean.argmax(1), self.common)
        powers = 10.0 ** (mean - mean.max(1, keepdims=True))
        score = np.where(some, 1 / powers.sum(1), 0.0)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], score


def train(docs: DataFrame) -> Model:
    """The model of all training documents; at most KEPT entries a level come to the driver."""
    return Model(shares(docs).select("level", "lang", "gram", "n", "total").toPandas())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; no shuffle."""
    ship = Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ship.get()
        for batch in batches:
            lang, score = mine.classify(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
