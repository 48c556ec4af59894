"""Small hand-made inputs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

FRAME = ("scenario_id string, city string, track_id string, object_type string, timestep int, observed boolean, position_x double,"
         " position_y double, velocity_x double, velocity_y double, heading double")


def track(name, x, y=lambda t: 0.0, vx=0.0, vy=0.0, heading=lambda t: 0.0, steps=range(110), scenario="s", kind="vehicle"):
    return [(scenario, "c", name, kind, t, t < 50, float(x(t)), float(y(t)), float(vx), float(vy), float(heading(t))) for t in steps]


def frames(spark, *tracks):
    return spark.createDataFrame([r for t in tracks for r in t], FRAME)


def future_pair(spark, distances, valid=None):
    """Joined pair with the given future distances; a stays at the origin."""
    valid = valid or [True] * len(distances)
    slots = [(float(d), 0.0) if ok else None for d, ok in zip(distances, valid)] + [None] * (60 - len(distances))
    origin = [(0.0, 0.0) if s else None for s in slots]
    fut = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame([("s", "a", "b", origin, slots)],
                               f"scenario_id string, a_track_id string, b_track_id string, a_future {fut}, b_future {fut}")
    path = F.expr("cast(array() as array<struct<t: int, x: double, y: double, vx: double, vy: double, h: double, ok: boolean>>)")
    return df.withColumns({"a_path": path, "b_path": path})


def wrapped(angle):
    return math.atan2(math.sin(angle), math.cos(angle))
