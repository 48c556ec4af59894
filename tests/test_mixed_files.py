"""Folders whose files differ in columns and widths."""

from __future__ import annotations

import pandas as pd

from kinepair.sources import tables


def write(folder, name, **columns):
    (folder / name).mkdir(parents=True)
    pd.DataFrame({"track_id": ["AV", "7"], "timestep": [0, 1], "position_x": [1.0, 2.0], **columns}).to_parquet(folder / name / f"scenario_{name}.parquet")


def test_columns_of_any_file_are_kept(spark, tmp_path):
    write(tmp_path, "a")
    write(tmp_path, "b", city=["oslo", "oslo"], start_timestamp=[1.5e18, 1.5e18])
    write(tmp_path, "c", city=["rome", "rome"], start_timestamp=pd.Series([3, 3], dtype="int64"))
    write(tmp_path, "d", position_y=pd.Series([1, 2], dtype="float32"), timestep=pd.Series([5, 6], dtype="int32"))
    got = {r.scenario_id: r for r in tables.read_frames(spark, str(tmp_path)).where("track_id = 'AV'").collect()}
    assert {k: (r.city, r.start_timestamp) for k, r in got.items()} == {"a": (None, None), "b": ("oslo", 1.5e18), "c": ("rome", 3.0), "d": (None, None)}
    assert (got["d"].position_y, got["d"].timestep, got["a"].position_y) == (1.0, 5, None)


def test_one_kind_of_file_is_read_by_its_pattern(spark, tmp_path):
    write(tmp_path, "a", city=["x", "x"])
    write(tmp_path, "b")
    groups = tables.schema_groups(spark, f"{tmp_path}/*/scenario_*.parquet")
    assert len(groups) == 1 and groups[0][1] == [f"{tmp_path}/*/scenario_*.parquet"] and "city" in groups[0][0].names
