"""Digests of files read in pieces, and trees of sources."""

from __future__ import annotations

import hashlib

import pyarrow as pa

from kinepair.sources import assets, lineage


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def tree(spark, root, config="c", code="k"):
    files = assets.file_digests(spark, f"{root}/*/*")
    return lineage.source_tree(lineage.source_files(files, str(root)), config, code)


def test_digests_of_empty_odd_and_large_files(spark, tmp_path):
    data = {"a/empty": b"", "a/with space": b"x", "b/é+%41": b"y" * 10, "b/none +é": b"", "b/large": bytes(range(256)) * 20_000}
    for name, value in data.items():
        put(tmp_path, name, value)
    got = {r["path"].removeprefix(f"{tmp_path}/"): (r["sha256"], r["size"]) for r in assets.file_digests(spark, f"{tmp_path}/*/*").collect()}
    assert got == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in data.items()}


def test_names_with_a_scheme(tmp_path):
    put(tmp_path, "a b é+%41#?x", b"z")
    name = f"file://{tmp_path}/a b é+%41#?x"
    got = [b.to_pylist() for b in assets._streamed(iter([pa.RecordBatch.from_pydict({"path": [name], "size": [1]})]))]
    assert got == [[{"path": name, "sha256": hashlib.sha256(b"z").hexdigest(), "size": 1}]]


def test_one_changed_byte_names_its_leaf(spark, tmp_path):
    for s in ("s1", "s2", "s3"):
        put(tmp_path, f"{s}/scenario_{s}.parquet", s.encode() * 9)
        put(tmp_path, f"{s}/log_map_archive_{s}.json", b"{}")
        put(tmp_path, f"{s}/notes.txt", b"not a source")
    rows = tree(spark, tmp_path).collect()
    old = spark.createDataFrame(rows, tree(spark, tmp_path).schema)
    assert lineage.changed_leaves(old, tree(spark, tmp_path)).count() == 0
    put(tmp_path, "s2/log_map_archive_s2.json", b"[}")
    new = tree(spark, tmp_path)
    assert [tuple(r) for r in lineage.changed_leaves(old, new).collect()] == [("s2", "s2/log_map_archive_s2.json", "changed")]
    assert [r[0] for r in lineage.stale(old, new).collect()] == ["s2"]
    code = tree(spark, tmp_path, code="k2")
    assert sorted(tuple(r) for r in lineage.changed_leaves(new, code).collect()) == [(s, "code", "changed") for s in ("s1", "s2", "s3")]
    assert {tuple(r) for r in lineage.changed_leaves(old.where("scenario_id <> 's1'"), old.where("scenario_id <> 's3'")).collect()} == {
        (s, leaf, state) for s, state in (("s1", "extra"), ("s3", "missing")) for leaf in ("config", "code", f"{s}/scenario_{s}.parquet", f"{s}/log_map_archive_{s}.json")}


def test_scenarios_have_one_file_of_each_kind(spark, tmp_path):
    put(tmp_path, "good/scenario_1.parquet", b"")
    put(tmp_path, "good/log_map_archive_1.json", b"")
    put(tmp_path, "twice/scenario_1.parquet", b"")
    put(tmp_path, "twice/scenario_2.parquet", b"")
    found = lineage.check_source_files(lineage.source_files(assets.file_digests(spark, f"{tmp_path}/*/*"), str(tmp_path)))
    assert {(r["rule"], r["key"]) for r in found.collect()} == {("one_frames_file", "twice"), ("one_map_file", "twice")}
