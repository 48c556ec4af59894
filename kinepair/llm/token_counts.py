"""Token counts for every context limit from one exact length histogram.

Documents are encoded once, in Python workers, and only their lengths are counted. All later answers come from the
histogram: with n documents of at least L tokens and t tokens in the documents shorter than L,
truncating at L keeps t + n * L tokens. Suffix sums over the histogram are
taken in two steps, over blocks of lengths and within a block, so no window spans the table.

Defined results: a null or empty text has length 0 and is counted; an empty table gives an empty histogram; repeated rows
count each; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinepair.sources.staging import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths per block of the suffix sums.
BLOCK = 1024
# Fixed value: the pattern by which the vocabulary's public encoder cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoder(path: str, pattern: str = PATTERN):
    """The byte-level BPE of a vocabulary of ranks; special strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path)
        for batch in batches:
            found = Counter(len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["length", "n"])

    return run


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, n_docs) of all whole texts; counted per batch before the shuffle, and written, so that texts are encoded once."""
    counted = docs.select("text").mapInArrow(_lengths(vocabulary), "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))
    return staged(counted, "lengths")


def suffix_sums(table: DataFrame) -> DataFrame:
    """The histogram with docs_from and tokens_from: documents of at least this length and their tokens."""
    rows = table.withColumns({"_b": F.floor(F.col("length") / BLOCK), "_t": F.col("length") * F.col("n_docs")})
    blocks = rows.groupBy("_b").agg(F.sum("n_docs").alias("_n"), F.sum("_t").alias("_s"))
    # One row per BLOCK lengths: for texts of up to a billion tokens these are a million rows.
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("_b", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(after), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(later, "_b").select("length", "n_docs", (F.sum("n_docs").over(within) + F.col("_n")).alias("docs_from"),
                                         (F.sum("_t").over(within) + F.col("_s")).alias("tokens_from"))


def limits(table: DataFrame) -> DataFrame:
    """One row per length that occurs, as a context limit.

    docs_over, tokens_over: documents longer than the limit and their tokens; kept_tokens: tokens left
    after truncation to the limit; quantile: share of documents of at most that length.
    Limits between two lengths follow by `truncated`.
    """
    total = table.agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("_tokens"))
    over_docs = F.col("docs_from") - F.col("n_docs")
    over_tokens = F.col("tokens_from") - F.col("length") * F.col("n_docs")
    return suffix_sums(table).crossJoin(F.broadcast(total)).select(
        "length", "n_docs", over_docs.alias("docs_over"), over_tokens.alias("tokens_over"),
        (F.col("_tokens") - over_tokens + F.col("length") * over_docs).alias("kept_tokens"), ((F.col("_docs") - over_docs) / F.col("_docs")).alias("quantile"))


def truncated(table: DataFrame, at: list[int]) -> DataFrame:
    """(context, kept_tokens, docs_over) for any limits, from the histogram alone."""
    rows = table.select("length", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in at])).alias("context"))
    return rows.groupBy("context").agg(F.sum(F.least("length", "context") * F.col("n_docs")).alias("kept_tokens"),
                                       F.sum(F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_over"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents does not exceed."""
    rows = limits(table).select("length", "quantile", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return rows.where("quantile >= share").groupBy("share").agg(F.min("length").alias("length"))
