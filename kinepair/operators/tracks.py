"""Track cleaning, quality and per-track features.

Input is the long table of track frames, one row per (scenario, track,
timestep). The operators gather it once into one row per track with array
columns (at most 50 observed and 60 future samples). Rows are shuffled and sorted by
track first; duplicated timesteps are merged in that order, so no array outgrows the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.config import (
    DT, EPS, FUTURE_START, GRID_LEN, OBS_LEN, SKIP_REASONS, VEHICLE_TYPES, BuildConfig,
)
from kinepair.functions import series
from kinepair.functions.scalar import finite, norm2, unwrap_correction

TRACK_KEY = ("scenario_id", "track_id")


def frame_validity(frames: DataFrame) -> DataFrame:
    """Adds `valid`: usable observed frame (position, velocity, heading) or future frame (position)."""
    xy = finite(F.col("position_x")) & finite(F.col("position_y"))
    full = xy & finite(F.col("velocity_x")) & finite(F.col("velocity_y")) & finite(F.col("heading"))
    t = F.col("timestep")
    observed = F.coalesce(F.col("observed"), F.lit(False))
    future = F.coalesce(~F.col("observed"), F.lit(False))
    return frames.withColumn(
        "valid",
        (observed & full & t.between(0, OBS_LEN - 1)) | (future & xy & t.between(FUTURE_START, GRID_LEN - 1)))


def distinct_frames(frames: DataFrame) -> DataFrame:
    """One row per (scenario, track, timestep, observed): the valid sample with the largest (x, y).

    `num_samples` counts the valid rows that were merged.
    """
    # One shuffle by track: it serves this grouping and the one into tracks, which then needs no further sort either.
    checked = frame_validity(frames).repartition(*TRACK_KEY)
    sample = F.struct(*[F.col(c).cast("double").alias(a) for c, a in (
        ("position_x", "x"), ("position_y", "y"), ("velocity_x", "vx"), ("velocity_y", "vy"), ("heading", "h"))])
    optional = [F.min(c).alias(c) for c in ("object_category", "city") if c in frames.columns]
    focal = (F.max((F.col("focal_track_id") == F.col("track_id")).cast("int"))
             if "focal_track_id" in frames.columns else F.lit(0))
    return checked.groupBy(*TRACK_KEY, "timestep", "observed").agg(
        F.max(F.when(F.col("valid"), sample)).alias("sample"),
        F.sum(F.col("valid").cast("int")).alias("num_samples"),
        F.min("object_type").alias("object_type"),
        F.coalesce(focal, F.lit(0)).alias("focal"), *optional)


def gather_tracks(frames: DataFrame) -> DataFrame:
    """One row per track: `obs` and `fut`, the valid samples in time order."""
    distinct = distinct_frames(frames)
    s = F.col("sample")
    t = F.col("timestep").cast("int").alias("t")
    observed = F.when(s.isNotNull() & F.col("observed"),
                      F.struct(t, *[s[k].alias(k) for k in ("x", "y", "vx", "vy", "h")]))
    future = F.when(s.isNotNull() & ~F.col("observed"), F.struct(t, s["x"].alias("x"), s["y"].alias("y")))
    optional = [F.min(c).alias(c) for c in ("object_category", "city") if c in frames.columns]
    return distinct.groupBy(*TRACK_KEY).agg(
        F.sort_array(F.collect_list(observed)).alias("obs"),
        F.sort_array(F.collect_list(future)).alias("fut"),
        F.min("object_type").alias("object_type"),
        (F.max("focal") == 1).alias("is_focal"),
        F.sum(F.greatest(F.col("num_samples") - 1, F.lit(0))).cast("bigint").alias("num_duplicate_frames"),
        *optional)


def _unwrapped(obs: Column) -> Column:
    """Headings of the samples without 2*pi jumps, as array<double>."""
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.lit(0.0).alias("shift"),
                     series.empty("double").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        moved = acc["shift"] + F.coalesce(unwrap_correction(p["h"] - acc["prev"]), F.lit(0.0))
        return series.bind(moved, lambda shift: F.struct(
            p["h"].alias("prev"), shift.alias("shift"),
            F.concat(acc["out"], F.array(p["h"] + shift)).alias("out")))

    # Most tracks never turn past pi; only the others carry a shift from sample to sample, in an array that is copied at each.
    turns = F.exists(F.zip_with(F.slice(obs, F.lit(2), F.greatest(F.size(obs) - 1, F.lit(0))), F.slice(obs, F.lit(1), F.greatest(F.size(obs) - 1, F.lit(0))),
                                lambda b, a: unwrap_correction(b["h"] - a["h"])), lambda v: v != 0)
    return F.when(F.coalesce(turns, F.lit(True)), F.aggregate(obs, start, step, lambda acc: acc["out"])).otherwise(
        F.transform(obs, lambda p: p["h"] + F.lit(0.0)))


def unwrap_headings(tracks: DataFrame) -> DataFrame:
    """Adds field `u`, the unwrapped heading, to the samples in `obs`."""
    return tracks.withColumn("obs", series.bind(F.col("obs"), lambda o: F.zip_with(
        o, _unwrapped(o),
        lambda p, u: F.struct(*[p[k].alias(k) for k in ("t", "x", "y", "vx", "vy", "h")], u.alias("u")))))


def fill_gaps(tracks: DataFrame) -> DataFrame:
    """Adds `path`: 50 dense observed samples.

    Missing samples are interpolated linearly between valid neighbours, take
    the nearest valid sample outside them, and are 0 for an empty track.
    Headings are interpolated unwrapped and wrapped again. `ok` marks samples
    that were really observed.
    """

    def segment(p: Column, nxt: Column, i: Column) -> Column:
        first = F.when(i == 0, F.lit(0)).otherwise(p["t"])
        last = F.when(nxt.isNull(), F.lit(OBS_LEN - 1)).otherwise(nxt["t"] - 1)

        def at(tt: Column) -> Column:
            part = F.when(nxt.isNotNull() & (tt > p["t"]),
                          (tt - p["t"]).cast("double") / (nxt["t"] - p["t"]))

            def value(k: str) -> Column:
                return F.coalesce(p[k] + (nxt[k] - p[k]) * part, p[k])

            return F.struct(
                tt.alias("t"), *[value(k).alias(k) for k in ("x", "y", "vx", "vy")],
                series.bind(value("u"), lambda u: F.atan2(F.sin(u), F.cos(u))).alias("h"),
                (tt == p["t"]).alias("ok"))

        return F.transform(F.sequence(first, last), at)

    def dense(obs: Column) -> Column:
        zeros = F.transform(F.sequence(F.lit(0), F.lit(OBS_LEN - 1)), lambda tt: F.struct(
            tt.alias("t"), *[F.lit(0.0).alias(k) for k in ("x", "y", "vx", "vy", "h")], F.lit(False).alias("ok")))
        pieces = F.transform(obs, lambda p, i: series.bind(F.get(obs, i + 1), lambda nxt: segment(p, nxt, i)))
        return F.when(F.size(obs) > 0, F.flatten(pieces)).otherwise(zeros)

    return tracks.withColumn("path", series.bind(F.col("obs"), dense))


def _accelerations(obs: Column) -> Column:
    """Per step between valid samples: acceleration norm, its lateral part and the heading rate."""

    def step(a: Column, b: Column) -> Column:
        gap = F.greatest((b["t"] - a["t"]).cast("double") * F.lit(DT), F.lit(EPS))
        return series.bind(
            F.struct(b["t"].alias("t"), ((b["vx"] - a["vx"]) / gap).alias("x"),
                     ((b["vy"] - a["vy"]) / gap).alias("y"), ((b["u"] - a["u"]) / gap).alias("rate")),
            lambda v: F.struct(v["t"].alias("t"), norm2(v["x"], v["y"]).alias("norm"),
                               (v["y"] * F.cos(b["h"]) - v["x"] * F.sin(b["h"])).alias("lateral"),
                               v["rate"].alias("rate")))

    return series.bind(obs, lambda o: F.when(F.size(o) >= 2, F.zip_with(
        F.slice(o, F.lit(1), F.size(o) - 1), F.slice(o, F.lit(2), F.size(o) - 1), step)).otherwise(
        series.empty("struct<t:int,norm:double,lateral:double,rate:double>")))


def accelerations(tracks: DataFrame) -> DataFrame:
    """Adds `acc`, one entry per step between valid samples."""
    return tracks.withColumn("acc", _accelerations(F.col("obs")))


def track_quality(tracks: DataFrame, cfg: BuildConfig = BuildConfig()) -> DataFrame:
    """Adds the quality measures and `skip_reason` (NULL for a kept track)."""

    def jumps(*keys: str) -> Column:
        counts = [series.jump_count(F.col("obs")[key], cfg.jump_sigma) for key in keys]
        return sum(counts[1:], counts[0])

    df = tracks.withColumns({
        "num_observed": F.size("obs"),
        "last_observed": F.coalesce(F.try_element_at("obs", F.lit(-1))["t"], F.lit(-1)),
        "pos_jumps": jumps("x", "y"),
        "vel_jumps": jumps("vx", "vy"),
        "heading_jumps": jumps("u"),
        "max_speed": F.coalesce(F.array_max(F.transform("obs", lambda p: norm2(p["vx"], p["vy"]))), F.lit(0.0)),
        "max_acc": F.coalesce(F.array_max(F.transform("acc", lambda a: a["norm"])), F.lit(0.0)),
    })
    # "has_missing" stays in the list of names; validity already excludes it.
    reason = (
        F.when(~F.col("object_type").isin(*VEHICLE_TYPES), SKIP_REASONS[0])
        .when(F.col("num_observed") < cfg.min_observed, SKIP_REASONS[1])
        .when(F.col("last_observed") < cfg.min_last_observed_timestep, SKIP_REASONS[2])
        .when(F.col("pos_jumps") > cfg.max_pos_jumps, SKIP_REASONS[4])
        .when(F.col("vel_jumps") > cfg.max_vel_jumps, SKIP_REASONS[5])
        .when(F.col("heading_jumps") > cfg.max_heading_jumps, SKIP_REASONS[6])
        .when(F.col("max_speed") > cfg.max_speed_mps, SKIP_REASONS[7])
        .when(F.col("max_acc") > cfg.max_acc_mps2, SKIP_REASONS[8]))
    return df.withColumn("skip_reason", reason)


def prepare_tracks(frames: DataFrame) -> DataFrame:
    """Gathered tracks with unwrapped headings and accelerations."""
    return accelerations(unwrap_headings(gather_tracks(frames)))


def motion_summary(tracks: DataFrame) -> DataFrame:
    """Adds speed, acceleration and heading-rate summaries; needs `path`, `obs` and `acc`."""
    speeds = F.transform("obs", lambda p: F.struct(norm2(p["vx"], p["vy"]).alias("v")))
    last = F.element_at("path", OBS_LEN)
    df = tracks.withColumns({
        "_speed": series.moments(speeds, "v"),
        "_acc": series.bind(F.col("acc"), lambda a: F.struct(*[
            series.moments(a, k)["std"].alias(k) for k in ("norm", "lateral", "rate")])),
    })
    return df.withColumns({
        "speed_current": norm2(last["vx"], last["vy"]),
        "speed_mean": F.col("_speed.mean"),
        "speed_std": F.col("_speed.std"),
        "acc_std": F.col("_acc.norm"),
        "lateral_acc_std": F.col("_acc.lateral"),
        "heading_rate_std": F.col("_acc.rate"),
        "observed_fraction": F.size("obs") / F.lit(float(OBS_LEN)),
    }).drop("_speed", "_acc")


def _dense_future(tracks: DataFrame) -> DataFrame:
    """Adds `future`: 60 slots, NULL where there is no valid future sample."""
    by_t = F.map_from_entries(F.transform(
        "fut", lambda p: F.struct(p["t"], F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    return tracks.withColumn("future", series.bind(by_t, lambda m: F.transform(
        F.sequence(F.lit(FUTURE_START), F.lit(GRID_LEN - 1)), lambda t: F.try_element_at(m, t))))


def build_nodes(frames: DataFrame, cfg: BuildConfig = BuildConfig(), keep_all: bool = False) -> DataFrame:
    """One row per kept track with dense path, future slots and summaries.

    `keep_all` keeps the rejected tracks as well (with their reason).
    """
    tracks = track_quality(prepare_tracks(frames), cfg)
    if not keep_all:
        # Exploded rows stop the filter, which would otherwise measure all tracks before the series are made, and the kept ones again after.
        tracks = keep_good(tracks.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*"))
    nodes = _dense_future(motion_summary(fill_gaps(tracks)))
    last, seen = F.element_at("path", OBS_LEN), F.try_element_at("obs", F.lit(-1))
    return nodes.withColumns({
        # The end of the path is the last sample seen; so these need no path.
        **{f"cur_{k}": F.coalesce(seen[k], F.lit(0.0)) for k in ("x", "y", "vx", "vy")},
        "cur_h": last["h"], "cur_ok": last["ok"],
        "ok_mask": F.aggregate("obs", F.lit(0).cast("bigint"), 
                               lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p["t"]))),
    }).drop("acc", "fut")


def keep_good(tracks: DataFrame) -> DataFrame:
    """Tracks that passed the quality cascade."""
    return tracks.where(F.col("skip_reason").isNull()).drop("skip_reason")


def node_features(nodes: DataFrame) -> DataFrame:
    """Adds `features`: 7 series of 50 values and 8 summaries; NaN and infinities become 0."""

    def take(fn) -> Column:
        return F.transform("path", fn)

    compact = [F.col(c) for c in ("speed_current", "speed_mean", "speed_std", "acc_std", "lateral_acc_std",
                                  "heading_rate_std", "observed_fraction")]
    raw = F.concat(
        take(lambda p: p["x"] - F.col("cur_x")), take(lambda p: p["y"] - F.col("cur_y")),
        take(lambda p: p["vx"]), take(lambda p: p["vy"]),
        take(lambda p: F.sin(p["h"])), take(lambda p: F.cos(p["h"])),
        take(lambda p: p["ok"].cast("double")),
        F.array(*compact, F.col("is_focal").cast("double")))
    clean = F.transform(raw, lambda v: F.when(finite(v), v).otherwise(F.lit(0.0)))
    return nodes.withColumn("features", clean)


def skip_counts(tracks: DataFrame) -> DataFrame:
    """Dropped tracks per scenario and reason, one column per reason."""
    return tracks.groupBy("scenario_id").agg(*[
        F.count_if(F.coalesce(F.col("skip_reason") == r, F.lit(False))).alias(f"filter_{r}")
        for r in SKIP_REASONS])


def scenario_labels(frames: DataFrame) -> DataFrame:
    """City and focal track per scenario (smallest non-null value) with the number of distinct values."""
    has_focal = "focal_track_id" in frames.columns
    focal = F.col("focal_track_id") if has_focal else F.lit(None).cast("string")
    return frames.groupBy("scenario_id").agg(
        F.coalesce(F.min("city"), F.lit("unknown")).alias("city"),
        F.coalesce(F.min(focal), F.lit("")).alias("focal_track_id"),
        F.count_distinct("city").alias("num_cities"))
