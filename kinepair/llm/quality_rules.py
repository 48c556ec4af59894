"""Quality rules as a bitmask ledger: measured once, judged by any number of policies.

The ledger keeps what was measured and one bit per failed rule. A policy is a
versioned set of rules; applying it is one bitwise AND, comparing policies or
leaving out rules never reads the texts again.

Defined results: a null text counts as empty and fails `few_words`; an empty table gives
an empty ledger; repeated rows are judged each for itself; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.llm.common import whole_text

# The characters that separate words, and those that count as symbols.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rule to failure condition over the measurements; the position is the rule's bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "10 * n_shouted > 3 * n_words"),
    ("exclamation", "10 * n_exclaims > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("mild_repetition", "100 * n_repeat_words > 30 * n_words"),
    ("some_symbols", "20 * n_symbols > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1-base": BASE,
    "v2-standard": (*BASE, "symbols", "duplicate_lines", "shouting", "exclamation", "short_words", "long_words"),
    "v3-strict": tuple(BIT),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_exclaims")


def mask_of(policy: str) -> int:
    """Bits of a policy."""
    return sum(BIT[rule] for rule in POLICIES[policy])


def _occurrences(text: Column, characters: str) -> Column:
    """How many one-byte characters of the text are among the given ones; by byte search, without a regex."""
    size = F.octet_length(text)
    return sum((size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters[1:]),
               size - F.octet_length(F.replace(text, F.lit(characters[0]), F.lit("")))).cast("long")


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its key and MEASURES, all long.

    Everything happens within a row: no shuffle, and a document's arrays are the most a
    task holds. Three-word windows are compared by a 64-bit hash of their words.
    """
    spaces = "[" + SPACES.replace("\t", r"\t").replace("\n", r"\n").replace("\x0b", r"\x0B").replace("\f", r"\f").replace("\r", r"\r") + "]+"
    base = docs.select(F.col(key), whole_text().alias("_t")).select(
        key, "_t",
        F.array_remove(F.split("_t", spaces), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("_l"))
    counted = base.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - _occurrences(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        _occurrences(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}{3,}")).cast("long").alias("n_shouted"),
        _occurrences(F.col("_t"), "!").alias("n_exclaims"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(
            F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))).alias("_g"))
    # Equal windows stand next to each other in sorted order.
    ordered = counted.withColumn("_g", F.sort_array("_g"))
    starts = F.filter("_g", lambda g, i: (g["h"] == F.get("_g", i - 1)["h"]) | (g["h"] == F.get("_g", i + 1)["h"]))
    repeated = ordered.withColumn("_r", F.transform(starts, lambda g: g["i"]))
    covered = F.array_distinct(F.flatten(F.transform("_r", lambda i: F.array(i, i + 1, i + 2))))
    return repeated.select(key, *[c for c in MEASURES if c != "n_repeat_words"],
                           F.when(F.size("_r") > 0, F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words")).select(key, *MEASURES)


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Measurements and `failed`, the bitmask of all failed rules, each rule evaluated once."""
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES[1:]),
               F.when(F.expr(RULES[0][1]), F.lit(1)).otherwise(0))
    return measure(docs, key).withColumn("failed", bits.cast("long"))


def apply_policy(table: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """The ledger with a boolean that says whether the policy keeps the document."""
    return table.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(table: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept without it.

    The ledger is first counted by bitmask (at most 2^rules rows, combined before
    the shuffle); the rules are then compared on those counts.
    """
    mask = mask_of(policy)
    counts = table.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    rows = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return rows.groupBy("rule").agg(total(hit)("failing"), total(hit & rest)("failing_alone"), total(rest)("kept_without"),
                                    F.bit_or(F.when(hit, F.col("bits"))).alias("met_with"))
