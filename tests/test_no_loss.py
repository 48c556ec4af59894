"""Cases in which rows must not get lost."""

import math

import pandas as pd
import pytest
from kinepair.config import BuildConfig
from kinepair.operators import manifest, metrics, pairs, splits, tracks
from kinepair.operators.audit import ConstraintError
from kinepair.sources import staging, tables
from pyspark.sql import functions as F

from helpers import frames, track


def test_certain_errors_cost_and_count(spark):
    rows = spark.createDataFrame([(0.0, 0), (1.0, 0), (1.0, 1), (0.5, 1)], "p double, y int")
    got = metrics.cross_entropy(rows, "p", "y").first()
    assert got.edges == 4 and got.loss == pytest.approx((100.0 + math.log(2)) / 4)
    logits = spark.createDataFrame([(-800.0, 0), (800.0, 0), (3.0, 1), (None, 1)], "z double, y int")
    got = metrics.cross_entropy_of_logits(logits, "z", "y").first()
    assert got.edges == 3 and got.loss == pytest.approx((800.0 + math.log1p(math.exp(-3.0))) / 3)


def test_contradictory_pairs_are_reported(spark):
    rows = [("s", "a", "b", 0.1, 0, True), ("s", "b", "a", 0.3, 1, True), ("s", "a", "c", 0.2, 1, True), ("s", "c", "a", 0.4, 1, True)]
    table = metrics.pair_scores(spark.createDataFrame(rows, "scenario_id string, src string, dst string, p double, label int, supervised boolean"), ["p"])
    assert [(r.rule, r.key) for r in metrics.check_pairs(table).collect()] == [("one_label", "s|a|b")]


def test_pairs_do_not_need_a_city(spark):
    table = frames(spark, track("a", lambda t: 0.1 * t), track("b", lambda t: 5 + 0.1 * t))
    for city in (F.lit(None).cast("string"), F.when(F.col("track_id") == "a", "x").otherwise("y"), F.lit("c")):
        nodes = pairs.number_nodes(tracks.keep_good(tracks.build_nodes(table.withColumn("city", city), keep_all=True)))
        found = pairs.build_pairs(nodes, BuildConfig()).collect()
        assert len(found) == 1 and found[0].city in ("unknown", "x", "c")


@pytest.mark.parametrize("kind", ["int32", "int64"])
def test_files_of_any_width_are_read(spark, tmp_path, kind):
    rows = pd.DataFrame([r for r in track("a", lambda t: t)], columns=["scenario_id", "city", "track_id", "object_type", "timestep", "observed", "position_x", "position_y", "velocity_x", "velocity_y", "heading"])
    rows = rows.assign(timestep=rows.timestep.astype(kind), object_category=pd.Series([3] * len(rows), dtype=kind), start_timestamp=pd.Series([315969904359876000] * len(rows), dtype="int64"), focal_track_id="a",
                       position_x=rows.position_x.astype("float32" if kind == "int32" else "float64"))
    (tmp_path / "s1").mkdir()
    rows.drop(columns="scenario_id").to_parquet(tmp_path / "s1" / "scenario_s1.parquet")
    got = tables.read_frames(spark, str(tmp_path))
    assert [f.dataType for f in got.schema.fields if f.name in tables.FRAMES.names] == [f.dataType for f in tables.FRAMES.fields]
    assert got.count() == len(rows) and got.agg(F.sum("timestep"), F.min("object_category"), F.min("start_timestamp")).first() == (sum(range(110)), 3, 315969904359876000.0)


def test_recordings_without_fingerprint_are_refused(spark):
    meta = spark.createDataFrame([("s1", "c", "r1", "h1", "f1"), ("s2", "c", "r2", "h2", "f2")], "scenario_id string, city string, recording_group_id_v2 string, content_sha1 string, focal_trajectory_hash_0p1m string")
    tokens = spark.createDataFrame([("s1", "c", "t")], "scenario_id string, city string, token string")
    with pytest.raises(ConstraintError, match="s2"):
        splits.components(meta, tokens)
    assert splits.components(meta, tokens.unionByName(tokens.withColumn("scenario_id", F.lit("s2")))).select("split_group_id").distinct().count() == 1
    for bad in ({"segment": 1}, {"stride": 0}):
        with pytest.raises(ValueError):
            splits.recorder_tokens(meta, **bad)


def test_long_chains_are_contracted_without_a_limit(spark):
    links = [(f"s{i:04d}", f"k{j:04d}") for i in range(300) for j in (i, i + 1)]
    got = splits.connect(spark.createDataFrame(links, "scenario_id string, key string")).select("root").distinct().collect()
    assert [r.root for r in got] == ["s0000"]


def test_outputs_of_an_older_schema_are_not_current(spark):
    schema = "scenario_id string, config_sha256 string, source_sha256 string, schema_version int"
    inputs = spark.createDataFrame([("a", "c", "s", 4), ("b", "c", "s", 4)], schema)
    outputs = spark.createDataFrame([("a", "c", "s", 4), ("b", "c", "s", 3)], schema)
    assert [r.scenario_id for r in manifest.pending(inputs, outputs).collect()] == ["b"]
    assert [r.scenario_id for r in manifest.incompatible(inputs, outputs).collect()] == ["b"]


def test_a_missing_city_is_not_the_total(spark):
    from kinepair.plans import queries_pairs

    table = queries_pairs.scenario_table(spark, "/root/testdata/sf0.001").withColumn("city", F.when(F.col("city") != "city0", F.col("city")))
    got = {(r.scope, r.city): r.num_graphs for r in manifest.corpus_summary(table).collect()}
    assert got[("total", None)] == table.count() and got[("city", None)] == table.where("city is null").count() > 0


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_discarded_stages_are_gone(spark):
    table = staging.staged(spark.range(10), "gone")
    path = table._staged_path
    assert table.count() == 10
    staging.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_graphs_are_published_together(spark, tmp_path):
    root = f"file://{tmp_path}/graphs"
    nodes = spark.createDataFrame([("s1", "c1", 1), ("s2", None, 2)], "scenario_id string, city string, v int")
    splits_ = spark.createDataFrame([("s1", "train"), ("s2", "val")], "scenario_id string, split string")
    with pytest.raises(ValueError, match="nothing is published"):
        tables.read_graphs(spark, root)
    first = tables.write_graphs(nodes, nodes, splits_, root)
    # A write that stops between nodes and edges is not seen.
    nodes.write.parquet(f"{root}/versions/broken/nodes")
    assert {r.v for r in tables.read_graphs(spark, root)[1].collect()} == {1, 2}
    tables.write_graphs(nodes.where("v = 2"), nodes.where("v = 2"), splits_, root)
    assert [r.v for r in tables.read_graphs(spark, root)[0].collect()] == [2]
    assert [r.v for r in tables.read_graphs(spark, root, "train", first)[1].collect()] == [1]
