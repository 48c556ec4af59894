"""Scenarios that cannot be built become error rows; all others are built."""

from __future__ import annotations

import json

import helpers
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinepair.operators import isolation, tracks
from kinepair.sources import tables

MAP = json.dumps({"lane_segments": {"1": {"id": 1, "centerline": [{"x": 0, "y": 0}, {"x": 1, "y": 0}]}}})


def recording(steps=110, **changed):
    rows = []
    for name in ("1", "2"):
        for t in range(steps):
            rows.append({"track_id": name, "object_type": "vehicle", "timestep": t, "observed": t < 50, "position_x": 5.0 * int(name) + t, "position_y": 0.0,
                         "velocity_x": 10.0, "velocity_y": 0.0, "heading": 0.0, "city": "oslo"})
    return pd.DataFrame(rows).assign(**changed)


def folder(root, name, data, text=MAP):
    (root / name).mkdir(parents=True)
    if data is not None:
        data.to_parquet(root / name / f"scenario_{name}.parquet")
    if text is not None:
        (root / name / f"log_map_archive_{name}.json").write_text(text)
    return root / name / f"scenario_{name}.parquet"


@pytest.fixture
def batch(tmp_path):
    """Two good scenarios and one of each kind of fault."""
    folder(tmp_path, "good1", recording())
    folder(tmp_path, "good2", recording())
    folder(tmp_path, "cutmap", recording(), MAP[:-3])
    folder(tmp_path, "nolanes", recording(), "{}")
    folder(tmp_path, "nomap", recording(), None)
    folder(tmp_path, "noframes", None)
    lost = recording()
    lost.loc[lost.track_id == "2", "position_x"] = float("nan")
    folder(tmp_path, "nantrack", lost)
    folder(tmp_path, "short", recording(40))
    folder(tmp_path, "nocolumn", recording().drop(columns="heading"))
    cut = folder(tmp_path, "cutfile", recording())
    cut.write_bytes(cut.read_bytes()[:-100])
    page = folder(tmp_path, "badpage", recording())
    data = bytearray(page.read_bytes())
    data[4:60] = b"\xff" * 56
    page.write_bytes(data)
    folder(tmp_path, "empty", recording()).write_bytes(b"")
    extra = folder(tmp_path, "twofiles", recording())
    recording().to_parquet(extra.parent / "scenario_other.parquet")
    return tmp_path


FIRST = {"cutmap": "unreadable_map", "nolanes": "map_without_lanes", "nomap": "missing_map_file", "noframes": "missing_frames_file", "nantrack": "track_without_positions",
         "short": "short_recording", "nocolumn": "missing_columns", "cutfile": "unreadable_frames", "badpage": "unreadable_frames", "empty": "missing_frames_file", "twofiles": "several_frames_files"}


def test_bad_folders_give_error_rows_and_good_ones_are_built(spark, batch):
    def build(frames, maps):
        both = tracks.build_nodes(frames).groupBy("scenario_id").agg(F.count("*").alias("num_nodes")).join(maps.select("scenario_id"), "scenario_id")
        return both.withColumn("status", F.lit("built"))

    table, counts = isolation.build_isolated(spark, str(batch), build)
    rows = {r.scenario_id: r for r in table.collect()}
    assert {k: r.reason for k, r in rows.items() if r.status == "error"} == FIRST
    assert {k: r.num_nodes for k, r in rows.items() if r.status == "built"} == {"good1": 2, "good2": 2}
    assert counts == {"built": 2, "exists": 0, "skipped": 0, "error": len(FIRST)}
    with pytest.raises(RuntimeError):
        tables.write_manifest(table, table.groupBy("status").count(), str(batch / "out"))


def test_good_rows_are_untouched(spark, batch):
    frames, maps, faults = isolation.read_validated(spark, str(batch))
    assert {r.scenario_id for r in maps.collect()} == {r.scenario_id for r in frames.select("scenario_id").distinct().collect()} == {"good1", "good2"}
    assert frames.count() == 440
    assert {r.scenario_id for r in faults.collect()} == set(FIRST)


def test_every_rule_on_rows_has_a_defect(spark):
    name = lambda r, **c: tuple(c.get(k, v) for k, v in zip(("scenario_id", "city", "track_id", "object_type", "timestep", "observed", "position_x"), r[:7])) + r[7:]
    step = lambda s: helpers.track("1", lambda t: t, scenario=s)
    rows = step("ok") + [name(r, track_id=None) if r[4] == 3 else r for r in step("key")] + [name(r, timestep=r[4] + 110) if r[4] in (0, 9) else r for r in step("grid")]
    rows += [name(r, city="other") if r[4] == 109 else r for r in step("cities")] + [name(r, position_x=float("inf")) for r in step("lost")] + helpers.track("1", lambda t: t, steps=range(50), scenario="short")
    rows += [name(r, timestep=None) if r[4] == 0 else r for r in step("nostep")]
    got = {(r.scenario_id, r.reason, r.detail) for r in isolation.frame_faults(spark.createDataFrame(rows, helpers.FRAME)).collect()}
    assert got == {("key", "rows_without_key", "1"), ("grid", "steps_off_grid", "2"), ("cities", "several_cities", "c other"), ("lost", "track_without_positions", "1 from 1"),
                   ("short", "short_recording", "49"), ("nostep", "rows_without_key", "1")}


def test_null_documents_and_empty_tables(spark):
    maps = spark.createDataFrame([("a", None), ("b", ""), ("c", '{"lane_segments": 3}'), ("d", MAP)], "scenario_id string, map_json string")
    assert {(r.scenario_id, r.reason) for r in isolation.map_faults(maps).collect()} == {("a", "unreadable_map"), ("b", "unreadable_map"), ("c", "map_without_lanes")}
    none = isolation.validated(spark.createDataFrame([], helpers.FRAME), maps.where("scenario_id = 'd'"))
    assert none.count() == 0
    table, counts = isolation.outcome(spark.createDataFrame([("x", "built")], "scenario_id string, status string"), none)
    assert table.count() == 1 and counts["error"] == 0 and counts["built"] == 1
