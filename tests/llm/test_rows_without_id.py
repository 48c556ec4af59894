"""Rows that ids do not tell apart, and columns with names that the stages use themselves."""

from collections import Counter

from pyspark.sql import functions as F

from kinepair.llm import exact_dedup, mixing, near_copies

CLASHING = ("_row", "_copy", "_of", "_digest", "_gone", "_ROW", "_all", "_times", "_n", "row", "kept", "text_sha256")


def test_mixing_takes_rows_by_themselves(spark):
    rows = [(None if i % 2 else 5, f"row{i} a b c", "en", "src0" if i < 40 else "src9") for i in range(80)] + [(None, "same a b c", "en", "src0")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for budget in (122, 402):
        taken = mixing.select(docs, budget=budget).collect()
        assert sum(r["used_tokens"] for r in taken) == budget
        out = Counter(tuple(r) for r in mixing.mixed(docs, budget=budget).collect())
        assert sum(out.values()) == len(taken) and sum(4 * n for n in out.values()) == sum(r["n_tokens"] for r in taken)
        assert all(n <= 2 * Counter(rows)[k] for k, n in out.items())


def test_one_row_of_a_text_stays(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "same"), (None, "same"), (None, "same"), (4, "twice"), (4, "twice"), (1, "other"), (None, "alone"), (7, "both"), (None, "both"), (None, long), (None, long), (None, long + " x")]
    docs = spark.createDataFrame([(i, t, "en", "src0") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.survivors(docs).collect())
    assert got == sorted([("None", "same"), ("4", "twice"), ("1", "other"), ("None", "alone"), ("7", "both"), ("None", long), ("None", long + " x")])
    near = sorted(r["text"] for r in near_copies.survivors(docs.where("text <> 'both'")).collect())
    assert near[:4] == ["alone", "other", "same", "twice"] and len(near) == 5


def test_columns_with_clashing_names_keep_their_values(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2} " + " ".join(f"w{i // 2}_{k}" for k in range(20)), "en", f"src{i % 3}") for i in range(40)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHING if c != "_ROW"})
    for stage in (exact_dedup.survivors, near_copies.survivors, lambda d: mixing.mixed(d, share_percent=150)):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHING if c != "_ROW")
