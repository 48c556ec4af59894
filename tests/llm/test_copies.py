"""Exact and near duplicates and archives against brute force."""

import hashlib
import io
import itertools
import random
from collections import Counter, defaultdict

import pyarrow.fs
import pytest
import xxhash
from kinepair.llm import exact_dedup, simhash, warc
from kinepair.llm.components import components
from pyspark.sql import functions as F

from odd_rows import empty_documents, lowered, odd_documents

LEAST = -(1 << 70)


def by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max(ids, key=lambda x: LEAST if x is None else x)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_equals_brute_force(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter(tuple(r) for r in exact_dedup.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == by_hand(rows)
    assert exact_dedup.dedup(empty_documents(spark)).count() == 0
    kept = exact_dedup.survivors(docs)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in got.items() if k[3])


def test_exact_dedup_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), F.col("id") % 1500)).alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(tuple(r) for r in exact_dedup.dedup(docs).collect()) == by_hand(rows)


def test_index_splits_and_chains():
    index, rng, want = exact_dedup.ExtendibleIndex(4), random.Random(1), {}
    for n in range(3000):
        text = f"text {rng.randrange(700)}".encode()
        # Few keys, so that many texts share one.
        key = (int(text.split()[1]) % 150) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        index.add(key, hashlib.sha256(text).hexdigest(), text, n, 1)
        want[text] = (n, want.get(text, (0, 0))[1] + 1)
    got = {e[1]: (e[3], e[4]) for b in index.buckets() for e in b[1]}
    assert got == {hashlib.sha256(t).hexdigest(): v for t, v in want.items()}
    assert len(index.directory) == 1 << index.depth and index.depth >= 4
    for slot, b in enumerate(index.directory):
        assert all((e[0] ^ slot) & ((1 << b[0]) - 1) == 0 for e in b[1])


def test_equal_digest_of_other_bytes_is_refused():
    index = exact_dedup.ExtendibleIndex()
    index.add(1, "d", b"one", 1, 1)
    with pytest.raises(ValueError):
        index.add(1, "d", b"two", 2, 1)


def test_index_is_extended_by_later_documents(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exact_dedup.build_index(first, f"file://{tmp_path}/1", 2)
    got = {r["sha"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.build_index(second, f"file://{tmp_path}/2", 2, f"file://{tmp_path}/1").collect()}
    assert got[sha("b")] == (4, 2) and got[sha("c")] == (5, 1) and got.get(sha("a"), (3, 2)) == (3, 2)
    files = pyarrow.fs.LocalFileSystem()
    loaded = [exact_dedup.ExtendibleIndex.load(files.open_input_file(str(p))) for p in (tmp_path / "1").glob("*.idx")]
    assert sorted(e[3] for x in loaded for b in x.buckets() for e in b[1]) == [2, 3]


def fingerprint(text):
    w = lowered(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_by_hand(rows):
    prints = {fp for _, _, fp in rows}
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    ids = defaultdict(list)
    for i, _, fp in rows:
        ids[root(fp)].append(i)
    return Counter((i, fp, min((x for x in ids[root(fp)] if x is not None), default=None)) for i, _, fp in rows)


def test_near_groups_equal_brute_force(spark, sf_dir):
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"], fingerprint(r["text"])) for r in docs.collect()]
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == near_by_hand(rows)
    assert len({k[2] for k in got}) < len(got)
    assert simhash.near_groups(empty_documents(spark)).count() == 0
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k[0] for k in got if k[0] == k[2]}


def test_links_lose_no_pair(spark):
    rng = random.Random(2)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            p ^= sum({1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 2, 3]))})
    signed = lambda p: p - (1 << 64) * (p >> 63)
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(table).collect()}
    assert got == {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(300, 301), (301, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and all(got[k] == 100 for k in range(101, 140)) and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def pages(spark):
    big, rows = "<p>é</p>" * 400, []
    rows = [(1, "http://a/1", big), (2, "http://a/2?x=%20\r\nSet: x", big), (3, None, big + "!"), (4, "u", ""), (5, "u", None), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (9, "u", big + "!"), (9, "u", big + "!"),
            (9, "v", "z" * 3_000_000), (10, "u", "WARC/1.1\r\n\r\n\r\n\r\n")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, sha string, n string")


def archived_by_hand(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(groups[h or ""], key=lambda x: LEAST if x is None else x)
        again = len(b) >= 1000 and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return Counter(out)


def test_archive_round_trip(spark):
    table = pages(spark)
    got = Counter(tuple(r) for r in warc.round_trip(table).collect())
    assert got == archived_by_hand([tuple(r)[:3] for r in table.collect()])
    assert warc.round_trip(table.where("false")).count() == 0


def test_records_are_found_by_frame(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 4000)
    table, folder = pages(spark), f"file://{tmp_path}/arc"
    index = warc.write_archive(table, folder)
    assert index.count() == table.count() and index.agg(F.max("frame")).first()[0] > 0
    got = {r["page_id"]: r for r in warc.read_records(folder, index, spark.createDataFrame([(2,), (6,), (77,)], "page_id long")).collect()}
    assert set(got) == {2, 6} and bytes(got[6]["payload"]) == b"short" and bytes(got[2]["payload"]) == ("<p>é</p>" * 400).encode()
    assert got[2]["url"] == "http://a/2?x=%20\r\nSet: x"


def test_bundle_is_plain_zstandard():
    import zstandard

    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.BundleWriter(out)
    places = [writer.add(warc.make_record(i, "u", bytes([i]) * 600_000, None)) for i in range(5)]
    writer.close()
    data = out.getvalue()
    source = pyarrow.BufferReader(data)
    reader = warc.BundleReader(source)
    for i, (frame, start) in enumerate(places):
        head, block, _ = warc.parse_record(reader.frame(frame), start)
        assert head["WARC-Record-ID"] == warc.record_name(i) and block.endswith(bytes([i]) * 600_000)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC-Type: response") == 5
