"""Vehicle pairs: radius join, histories, edge features, gates and masks.

Most pair quantities are the same in both directions, so the join emits every
unordered pair once and its 110 steps are generated, used and reduced by
built-in aggregates inside the stage of the join (map-side combine). Only
finished pair rows are exchanged afterwards, so AQE may split a crowded join
partition at will. `directed_edges` then turns a pair into its two directed
edges using current-frame scalars only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinepair.config import (
    BASE_MODE, DT, EDGE_FEATURES, EPS, FUTURE_LEN, GRID_LEN, OBS_LEN, RESIDUAL_FEATURES, RESIDUAL_MODE, BuildConfig,
    RiskConfig,
)
from kinepair.functions.ranks import running_before
from kinepair.functions.scalar import angle_diff, norm2
from kinepair.sources.staging import staged_with

#: City of scenarios that name none.
NO_CITY = "unknown"
RESIDUAL_STATES = 11
RESIDUAL_EPS = 1e-8


#: Vehicles of the a side in one cell; a cell with more is cut, at most FINEST times in four, and then dealt out.
CROWD, FINEST = 512, 5


def crowded_cells(points: DataFrame, side: float, crowd: int = CROWD, keys: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """Leaves of the quadtrees of cells with more than `crowd` of the `points` (keys, x, y).

    One row per occupied leaf: keys, `_cx`, `_cy` (the cell of the given side), `_depth`, `_lx`, `_ly` (the leaf's place in the grid of side
    side / 2 ** depth) and `_parts`, 1 but for leaves of the finest depth that still hold more. Only counts of cells are aggregated.
    """
    fine = points.select(*keys, *[F.floor(F.col(c) / F.lit(side / 2 ** FINEST)).cast("bigint").alias(f) for f, c in (("_fx", "x"), ("_fy", "y"))])
    counted = fine.groupBy(*keys, "_fx", "_fy").agg(F.count(F.lit(1)).alias("_n"))

    def at(depth: int) -> list[Column]:
        return [F.shiftright(c, FINEST - depth) for c in ("_fx", "_fy")]

    # Finest cells of one coarse cell: at most 4 ** FINEST rows.
    sizes = {f"_n{d}": F.sum("_n").over(W.partitionBy(*keys, *at(d))) for d in range(FINEST + 1)}
    depth = F.coalesce(*[F.when(F.col(f"_n{d}") <= crowd, F.lit(d)) for d in range(FINEST + 1)], F.lit(FINEST))
    cut = counted.withColumns(sizes).where(F.col("_n0") > crowd).withColumn("_depth", depth)
    shift = F.lit(FINEST) - F.col("_depth")
    leaf = [F.call_function("shiftright", F.col(f), shift).alias(n) for f, n in (("_fx", "_lx"), ("_fy", "_ly"))]
    size = F.when(F.col("_depth") == FINEST, F.col(f"_n{FINEST}")).otherwise(F.lit(1))
    parts = F.ceil(size / F.lit(float(crowd))).cast("int")
    return cut.select(*keys, *[c.alias(n) for c, n in zip(at(0), ("_cx", "_cy"))], "_depth", *leaf, parts.alias("_parts")).distinct()


def radius_pairs(nodes: DataFrame, radius: float = 60.0, cell: float | None = None, crowd: int = CROWD,
                 keys: tuple[str, ...] = ("scenario_id",), key: str = "track_id",
                 x: str = "cur_x", y: str = "cur_y") -> DataFrame:
    """Unordered pairs a < b of one scenario at most `radius` apart; columns get prefixes a_ and b_.

    Scenarios are counted first, from their keys alone. One with at most `crowd` vehicles is joined as a whole, so no row is copied and both sides are one
    shuffle by scenario, which also serves what follows. In the others the plane is cut into square cells (default side 2 * radius). The a side
    stays in its own cell, the b side is copied to every cell its search box
    touches (4 on average), so each pair meets in exactly one cell. Cells are counted as well, from keys and coordinates alone; those with more than
    `crowd` vehicles are cut by a quadtree, and what shares even the finest cell is dealt over several parts. The b side is copied
    to every leaf and part that its box touches, so no task gets more than `crowd` of the a side for one key.
    """
    dx, dy = F.col(f"b_{x}") - F.col(f"a_{x}"), F.col(f"b_{y}") - F.col(f"a_{y}")
    close = (F.col(f"a_{key}") < F.col(f"b_{key}")) & (norm2(dx, dy) <= F.lit(float(radius)))
    own = [c for c in nodes.columns if c not in keys]
    counted = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select(*keys)
    busy, found = staged_with(counted, "crowded-scenarios", F.count(F.lit(1)).alias("n"))
    if not found["n"]:
        a, b = (nodes.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in own]) for side in ("a", "b"))
        return a.join(b, [*keys]).where(close)
    nodes = nodes.join(busy.withColumn("_busy", F.lit(True)), [*keys], "left")
    side = float(cell or 2.0 * radius)
    leaves, found = staged_with(crowded_cells(nodes.where("_busy").select(*keys, F.col(x).alias("x"), F.col(y).alias("y")), side, crowd, keys), "crowded", F.count(F.lit(1)).alias("n"))

    def index(c: Column, depth: Column | None = None) -> Column:
        return F.floor(c / (F.lit(side) if depth is None else F.lit(side) / F.pow(F.lit(2.0), depth))).cast("bigint")

    one = F.lit(0).cast("bigint")
    a, b = (nodes.select(*keys, *[F.col(c).alias(f"{side_of}_{c}") for c in own], "_busy") for side_of in ("a", "b"))
    for axis, c in (("_cx", x), ("_cy", y)):
        value = F.col(f"b_{c}")
        a = a.withColumn(axis, F.when(F.col("_busy"), index(F.col(f"a_{c}"))).otherwise(one))
        b = b.withColumn(axis, F.explode(F.when(F.col("_busy"), F.sequence(index(value - F.lit(radius)), index(value + F.lit(radius)))).otherwise(F.array(one))))
    on = [*keys, "_cx", "_cy"]
    if found["n"]:
        # Leaves come from a written table, so Spark knows whether they are small enough to be sent to all tasks.
        depths = leaves.select(*on, "_depth", "_lx", "_ly", "_parts")
        by_cell = depths.groupBy(*on).agg(F.collect_list(F.struct("_depth", "_lx", "_ly", "_parts")).alias("_leaves"))
        a, b = a.join(by_cell, on, "left"), b.join(by_cell, on, "left")
        whole = F.array(F.struct(F.lit(0).alias("_depth"), F.col("_cx").alias("_lx"), F.col("_cy").alias("_ly"), F.lit(1).alias("_parts")))

        def touched(side_of: str, reach: float) -> Column:
            def inside(leaf: Column) -> Column:
                ok = F.lit(True)
                for place, c in (("_lx", x), ("_ly", y)):
                    value = F.col(f"{side_of}_{c}")
                    ok = ok & leaf[place].between(index(value - F.lit(reach), leaf["_depth"]), index(value + F.lit(reach), leaf["_depth"]))
                return ok
            return F.explode(F.when(F.col("_busy"), F.filter(F.coalesce("_leaves", whole), inside)).otherwise(whole))

        a = a.withColumn("_leaf", touched("a", 0.0)).select("*", "_leaf.*").withColumn("_part", F.pmod(F.xxhash64(f"a_{key}"), F.col("_parts")).cast("int"))
        b = b.withColumn("_leaf", touched("b", float(radius))).select("*", "_leaf.*").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        extra = ["_leaves", "_leaf", "_parts"]
        a, b, on = a.drop(*extra), b.drop(*extra), [*on, "_depth", "_lx", "_ly", "_part"]
    return (a.drop("_busy").join(b.drop("_busy"), on)
            .where(close)
            .drop("_cx", "_cy", "_depth", "_lx", "_ly", "_part"))


def closing_speed(rx: Column, ry: Column, dist: Column, vx: Column, vy: Column) -> Column:
    """Negative relative velocity along the line of sight."""
    safe = F.greatest(dist, F.lit(EPS))
    return -(vx * (rx / safe) + vy * (ry / safe))


def residual_weights() -> dict[str, list[float]]:
    """Weights over the eleven frames: DCT orders 1-3 of the detrended series, and its trend.

    sum_i w_i p_i is the DCT coefficient of p after removing its straight-line
    fit: detrending is linear, so the fit is folded into the cosine basis once.
    """
    n = RESIDUAL_STATES
    time = [(i - (n - 1)) * DT for i in range(n)]
    mean_t = sum(time) / n
    spread = sum((t - mean_t) ** 2 for t in time)
    weights = {"trend": [(t - mean_t) / spread for t in time]}
    for k in (1, 2, 3):
        basis = [math.sqrt(2.0 / n) * math.cos(math.pi * k * (i + 0.5) / n) for i in range(n)]
        level = sum(basis) / n
        tilt = sum(b * (t - mean_t) for b, t in zip(basis, time)) / spread
        weights[f"dct{k}"] = [b - level - tilt * (t - mean_t) for b, t in zip(basis, time)]
    return weights


def pair_frames(pairs: DataFrame, keep: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """One row per pair and grid step from `first` on, latest step first.

    Columns: step `t` 0..109, relative position and velocity (`rx, ry, rvx,
    rvy`), distance `d` where both sides are valid, closing speed `c` for
    observed steps. Steps run backwards so that an arg-min over them keeps the
    earliest of equal values. Without observed steps the paths are not needed, and the velocities are null.
    """
    ids = [c for c in ("scenario_id", "city", "variant", "a_track_id", "b_track_id") if c in pairs.columns]
    t = F.col("t")
    paths = ["a_path", "b_path"] if first < OBS_LEN else []
    pick = pairs.select(*ids, *keep, *paths, "a_future", "b_future",
                        F.explode(F.sequence(F.lit(GRID_LEN - 1), F.lit(first), F.lit(-1))).alias("t"))
    f, g = F.get(F.col("a_future"), t - OBS_LEN), F.get(F.col("b_future"), t - OBS_LEN)
    if not paths:
        nothing = F.lit(None).cast("double")
        step = pick.withColumns({"rx": g["x"] - f["x"], "ry": g["y"] - f["y"], "rvx": nothing, "rvy": nothing})
        return step.withColumn("d", norm2(F.col("rx"), F.col("ry"))).withColumn("c", nothing)
    p, q = F.get(F.col("a_path"), t), F.get(F.col("b_path"), t)
    seen = (t < OBS_LEN) & p["ok"] & q["ok"]
    step = pick.withColumns({
        "rx": F.when(seen, q["x"] - p["x"]).when(t >= OBS_LEN, g["x"] - f["x"]),
        "ry": F.when(seen, q["y"] - p["y"]).when(t >= OBS_LEN, g["y"] - f["y"]),
        "rvx": F.when(seen, q["vx"] - p["vx"]), "rvy": F.when(seen, q["vy"] - p["vy"]),
    }).withColumn("d", norm2(F.col("rx"), F.col("ry")))
    return step.withColumn("c", closing_speed(*[F.col(c) for c in ("rx", "ry", "d", "rvx", "rvy")]))


def history_aggregates() -> list[Column]:
    """Aggregates of pair steps that make up the history part of the edge features."""
    t, d, c = F.col("t").cast("double"), F.when(F.col("t") < OBS_LEN, F.col("d")), F.col("c")
    # A step is late when at most 20 commonly valid steps remain from it on.
    left = F.bit_count(F.call_function(
        "shiftrightunsigned", F.col("a_ok_mask").bitwiseAND(F.col("b_ok_mask")), F.col("t")))
    late = left <= 20
    return [
        F.count(c).alias("num_common_observed"), F.min(d).alias("d_min_obs"), F.avg(d).alias("d_mean_obs"),
        F.stddev_pop(d).alias("d_std_obs"), F.regr_slope(d, t).alias("d_trend"),
        F.regr_slope(F.when(F.col("t") < OBS_LEN // 2, d), t).alias("d_trend_early"),
        F.regr_slope(F.when(late, d), t).alias("d_trend_late"),
        F.avg(c).alias("closing_speed_mean"), F.max(c).alias("closing_speed_max"),
        F.stddev_pop(c).alias("closing_speed_std"), F.avg(F.when(late, c)).alias("closing_speed_late"),
        F.regr_slope(c, t).alias("closing_speed_trend")]


def residual_aggregates() -> list[Column]:
    """Weighted sums over the last eleven observed frames; see `residual_weights`."""
    first = OBS_LEN - RESIDUAL_STATES
    at = F.col("t") - first
    out = [F.count_if(at.between(0, RESIDUAL_STATES - 1) & F.col("c").isNotNull()).alias("_res_n"),
           F.max(F.when(F.col("t") == OBS_LEN - 1, F.col("rx"))).alias("_last_rx"),
           F.max(F.when(F.col("t") == OBS_LEN - 1, F.col("ry"))).alias("_last_ry"),
           F.max(F.when(F.col("t") == OBS_LEN - 1, F.col("rvx"))).alias("_last_rvx"),
           F.max(F.when(F.col("t") == OBS_LEN - 1, F.col("rvy"))).alias("_last_rvy")]
    for name, weights in residual_weights().items():
        w = F.when(at.between(0, RESIDUAL_STATES - 1), F.get(F.array(*[F.lit(v) for v in weights]), at))
        out += [F.sum(F.col(axis) * w).alias(f"_{name}_{axis}") for axis in ("rx", "ry")]
    return out


def future_aggregates() -> list[Column]:
    """Nearest future approach and coverage."""
    d = F.when(F.col("t") >= OBS_LEN, F.col("d"))
    t = F.when(d.isNotNull(), F.col("t"))
    return [F.min(d).alias("future_min_distance"), F.min_by(t, d).alias("future_min_timestep"),
            F.count(d).cast("int").alias("pair_future_count"), F.min(t).alias("future_first_valid_timestep"),
            F.max(t).alias("future_last_valid_timestep")]


def finish_history(df: DataFrame) -> DataFrame:
    """Fallbacks for pairs with fewer than two common frames."""
    current = norm2(F.col("b_cur_x") - F.col("a_cur_x"), F.col("b_cur_y") - F.col("a_cur_y"))
    enough = F.col("num_common_observed") >= 2
    fallback = {"d_min_obs": current, "d_mean_obs": current}
    return df.withColumns({n: F.when(enough, F.coalesce(F.col(n), F.lit(0.0))).otherwise(fallback.get(n, F.lit(0.0)))
                           for n in EDGE_FEATURES[6:17]})


def finish_residual(df: DataFrame) -> DataFrame:
    """Projects the weighted sums on the line of sight and its normal; zeros for an incomplete window."""
    c = F.col
    df = df.withColumn("_dist", norm2(c("_last_rx"), c("_last_ry")))
    usable = (c("_res_n") == RESIDUAL_STATES) & (c("_dist") > F.lit(RESIDUAL_EPS))
    lx, ly = c("_last_rx") / c("_dist"), c("_last_ry") / c("_dist")

    def los(x: Column, y: Column) -> Column:
        return x * lx + y * ly

    def tangent(x: Column, y: Column) -> Column:
        return y * lx - x * ly

    vel = (c("_last_rvx") - c("_trend_rx"), c("_last_rvy") - c("_trend_ry"))
    values = [*[los(c(f"_dct{k}_rx"), c(f"_dct{k}_ry")) for k in (1, 2, 3)],
              *[tangent(c(f"_dct{k}_rx"), c(f"_dct{k}_ry")) for k in (1, 2)], los(*vel), tangent(*vel), F.lit(1.0)]
    out = df.withColumns({n: F.when(usable, v).otherwise(F.lit(0.0)) for n, v in zip(RESIDUAL_FEATURES, values)})
    return out.drop(*[n for n in out.columns if n.startswith(("_res_n", "_last_", "_dct", "_trend", "_dist"))])


def finish_future(df: DataFrame, cfg: BuildConfig = BuildConfig()) -> DataFrame:
    """Span, fraction, computability and the proximity label."""
    n, last = F.col("pair_future_count"), F.col("future_last_valid_timestep")
    computable = n >= cfg.min_pair_future
    return df.withColumns({
        "future_valid_span": F.coalesce(last - F.col("future_first_valid_timestep") + 1, F.lit(0)),
        "future_valid_fraction": n / F.lit(float(FUTURE_LEN)),
        "label_computable": computable,
        "label_strict": F.coalesce(computable & (n >= cfg.strict_pair_future)
                                   & (last >= cfg.strict_future_last_timestep), F.lit(False)),
        "label_proximity": F.coalesce(
            computable & (F.col("future_min_distance") <= F.lit(cfg.future_risk_distance_m)), F.lit(False)).cast("int"),
    })


NODE_SCALARS = ("track_id", "cur_x", "cur_y", "cur_vx", "cur_vy", "cur_h", "cur_ok", "speed_current", "speed_mean",
                "acc_std", "lateral_acc_std")
LANE_SCALARS = ("lane_id", "lane_distance", "lane_heading", "lane_is_intersection")


def directed_edges(pairs: DataFrame) -> DataFrame:
    """Both directed edges of every pair; a_/b_ scalars become src_/dst_, array columns are dropped."""
    own = [c[2:] for c in pairs.columns if c.startswith("a_") and c[2:] not in ("path", "future", "ok_mask")]
    shared = [c for c in pairs.columns if not c.startswith(("a_", "b_"))]

    def view(src: str, dst: str) -> Column:
        return F.struct(*[F.col(f"{src}_{c}").alias(f"src_{c}") for c in own],
                        *[F.col(f"{dst}_{c}").alias(f"dst_{c}") for c in own])

    return pairs.select(*shared, F.explode(F.array(view("a", "b"), view("b", "a"))).alias("_e")).select(*shared, "_e.*")


def edge_features(edges: DataFrame) -> DataFrame:
    """Adds the directional edge features to directed edges with node scalars and history columns."""
    c = F.col
    df = edges.withColumns({
        "rel_x_current": c("dst_cur_x") - c("src_cur_x"), "rel_y_current": c("dst_cur_y") - c("src_cur_y"),
        "rel_vx_current": c("dst_cur_vx") - c("src_cur_vx"), "rel_vy_current": c("dst_cur_vy") - c("src_cur_vy"),
    }).withColumn("d_current", norm2(c("rel_x_current"), c("rel_y_current")))
    safe = F.greatest(c("d_current"), F.lit(EPS))
    ux, uy = c("rel_x_current") / safe, c("rel_y_current") / safe
    hdiff = angle_diff(c("dst_cur_h"), c("src_cur_h"))
    to_dst = angle_diff(F.atan2(c("rel_y_current"), c("rel_x_current")), c("src_cur_h"))
    to_src = angle_diff(F.atan2(-c("rel_y_current"), -c("rel_x_current")), c("dst_cur_h"))
    return df.withColumns({
        "closing_speed_current": closing_speed(c("rel_x_current"), c("rel_y_current"), c("d_current"),
                                               c("rel_vx_current"), c("rel_vy_current")),
        "heading_diff_sin": F.sin(hdiff), "heading_diff_cos": F.cos(hdiff),
        "src_heading_to_dst_sin": F.sin(to_dst), "src_heading_to_dst_cos": F.cos(to_dst),
        "dst_heading_to_src_sin": F.sin(to_src), "dst_heading_to_src_cos": F.cos(to_src),
        "src_velocity_toward_dst": c("src_cur_vx") * ux + c("src_cur_vy") * uy,
        "dst_velocity_toward_src": -(c("dst_cur_vx") * ux + c("dst_cur_vy") * uy),
        "speed_delta_src_minus_dst": c("src_speed_current") - c("dst_speed_current"),
    })


def feature_columns(mode: str = BASE_MODE) -> tuple[str, ...]:
    """Edge feature names of a mode: 34, or 34 + 8."""
    if mode == BASE_MODE:
        return EDGE_FEATURES
    if mode == RESIDUAL_MODE:
        return EDGE_FEATURES + RESIDUAL_FEATURES
    raise ValueError(f"unknown edge feature mode: {mode!r}")


def feature_protocol(mode: str = BASE_MODE) -> dict:
    feature_columns(mode)
    extra = mode == RESIDUAL_MODE
    return {"mode": mode, "base_feature_mode": BASE_MODE, "extra_feature_dim": len(RESIDUAL_FEATURES) if extra else 0,
            "window_states": RESIDUAL_STATES, "constant_velocity_trend_removed": extra,
            "pair_local_los_frame": extra, "model_outputs_used": False, "labels_used": False}


def kinematic_gate(edges: DataFrame, cfg: BuildConfig = BuildConfig()) -> DataFrame:
    """Adds the near, dynamic and far-receding tests and the resulting candidate flag."""
    c = F.col
    near = (c("d_current") <= cfg.candidate_close_distance_m) | (c("d_min_obs") <= cfg.candidate_recent_close_distance_m)
    approach = ((c("d_trend") <= cfg.candidate_approach_trend_m_per_step)
                | (c("d_trend_late") <= cfg.candidate_approach_trend_m_per_step)
                | (c("closing_speed_current") >= cfg.candidate_closing_speed_mps)
                | (c("closing_speed_max") >= cfg.candidate_closing_speed_max_mps))
    receding = ((c("d_current") > cfg.candidate_far_distance_m)
                & (c("d_trend_late") > cfg.candidate_receding_trend_m_per_step)
                & (c("closing_speed_current") < -0.2)
                & (c("closing_speed_max") < cfg.candidate_closing_speed_mps))
    return edges.withColumns({
        "kinematic_near": near,
        "kinematic_dynamic": (c("d_current") <= cfg.candidate_dynamic_distance_m) & approach,
        "kinematic_far_receding": receding,
    }).withColumn("kinematic_candidate", (c("kinematic_near") | c("kinematic_dynamic")) & ~c("kinematic_far_receding"))


def edge_masks(edges: DataFrame) -> DataFrame:
    """Adds the mask lattice raw, physical, task, supervision and the risk label.

    Edges without a `map_candidate` column count as physically possible.
    """
    c = F.col
    df = edges if "map_candidate" in edges.columns else edges.withColumn("map_candidate", F.lit(True))
    return df.withColumns({
        "raw_edge": F.lit(True),
        "physical_possible": c("map_candidate"),
        "message_passing": c("map_candidate"),
        "task_candidate": c("map_candidate") & c("kinematic_candidate"),
        "hard_pruned": ~c("map_candidate"),
        "soft_task_excluded": c("map_candidate") & ~c("kinematic_candidate"),
        "supervision": c("map_candidate") & c("kinematic_candidate") & c("label_computable"),
        "label_risk": F.when(c("map_candidate") & c("kinematic_candidate"), c("label_proximity")).otherwise(F.lit(0)),
    })


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Adds dense `node_id` per scenario in track_id order; only ids are ranked, series are joined back."""
    ids = running_before(nodes.select("scenario_id", "track_id"), ["scenario_id"], "track_id", F.lit(1), "node_id")
    return nodes.join(ids.withColumn("node_id", F.col("node_id").cast("int")), ["scenario_id", "track_id"])


def number_edges(edges: DataFrame, src: str = "src_track_id", dst: str = "dst_track_id") -> DataFrame:
    """Adds dense `edge_id` per scenario in (src, dst) order.

    The offset of a source comes from edge counts per source, the rank within
    a source from a window over its own edges only.
    """
    per_src = edges.groupBy("scenario_id", src).agg(F.count("*").alias("_n"))
    offsets = running_before(per_src, ["scenario_id"], src, F.col("_n"), "_offset").drop("_n")
    rank = F.row_number().over(W.partitionBy("scenario_id", src).orderBy(dst))
    return (edges.withColumn("_rank", rank).join(offsets, ["scenario_id", src])
            .withColumn("edge_id", F.col("_offset") + F.col("_rank") - 1).drop("_rank", "_offset"))


def reverse_edges(edges: DataFrame, src: str = "src", dst: str = "dst", edge_id: str = "edge_id") -> DataFrame:
    """Adds `reverse_edge_id` (-1 if absent) and `num_reverse`, which exceeds 1 for duplicated edges."""
    back = edges.groupBy("scenario_id", F.col(dst).alias(src), F.col(src).alias(dst)).agg(
        F.min(edge_id).alias("reverse_edge_id"), F.count("*").alias("num_reverse"))
    return edges.join(back, ["scenario_id", src, dst], "left").withColumns({
        "reverse_edge_id": F.coalesce("reverse_edge_id", F.lit(-1)),
        "num_reverse": F.coalesce("num_reverse", F.lit(0))})


def summarise_pairs(pairs: DataFrame, cfg: BuildConfig = BuildConfig(), risk: RiskConfig | None = None,
                    parts: tuple[str, ...] = ("history", "residual", "future")) -> DataFrame:
    """Reduces every pair's steps to one row.

    Steps are generated and combined inside the join's own stage; only the
    finished pair row (a few hundred bytes, no arrays) is exchanged. The final
    key spreads a crowded scenario over all tasks.
    """
    from kinepair.operators.risk import finish_risk, risk_aggregates, risk_steps

    scalars = [c for c in pairs.columns if c[:2] in ("a_", "b_") and c[2:] in (*NODE_SCALARS[1:], *LANE_SCALARS, "node_id")]
    masks = ["a_ok_mask", "b_ok_mask"] if "history" in parts else []
    steps = pair_frames(pairs, keep=(*scalars, *masks), first=0 if {"history", "residual"} & set(parts) else OBS_LEN)
    aggregates = []
    if "history" in parts:
        aggregates += history_aggregates()
    if "residual" in parts:
        aggregates += residual_aggregates()
    if "future" in parts:
        aggregates += future_aggregates()
    if risk is not None:
        steps = risk_steps(steps, risk)
        aggregates += risk_aggregates()
    ids = [c for c in ("scenario_id", "city", "variant", "a_track_id", "b_track_id") if c in pairs.columns]
    df = steps.groupBy(*ids).agg(*[F.first(c).alias(c) for c in scalars], *aggregates)
    if "history" in parts:
        df = finish_history(df)
    if "residual" in parts:
        df = finish_residual(df)
    if "future" in parts:
        df = finish_future(df, cfg)
    return df if risk is None else finish_risk(df, risk)


def join_pairs(nodes: DataFrame, cfg: BuildConfig = BuildConfig(), crowd: int = CROWD) -> DataFrame:
    """Radius pairs with the columns the summaries need."""
    wanted = [c for c in (*NODE_SCALARS, *LANE_SCALARS, "node_id", "ok_mask", "path", "future") if c in nodes.columns]
    if "city" not in nodes.columns:
        return radius_pairs(nodes.select("scenario_id", *wanted), cfg.radius_m, crowd=crowd)
    # A pair is of one scenario; the city is carried, not joined on, so a missing or differing one loses no pair.
    named = nodes.select("scenario_id", F.coalesce("city", F.lit(NO_CITY)).alias("city"), *wanted)
    pairs = radius_pairs(named, cfg.radius_m, crowd=crowd)
    return pairs.withColumn("city", F.least("a_city", "b_city")).drop("a_city", "b_city")


def build_pairs(nodes: DataFrame, cfg: BuildConfig = BuildConfig(), risk: RiskConfig | None = None,
                crowd: int = CROWD) -> DataFrame:
    """Unordered pairs with history, residual, future and (optionally) risk columns."""
    return summarise_pairs(join_pairs(nodes, cfg, crowd), cfg, risk)


def build_edges(nodes: DataFrame, cfg: BuildConfig = BuildConfig(), lane_neighbors: DataFrame | None = None,
                risk: RiskConfig | None = None, crowd: int = CROWD) -> DataFrame:
    """Directed edge table: features, gates, masks, proximity and (with `risk`) dynamic-risk columns."""
    from kinepair.operators.lanes import lane_relations

    edges = edge_features(directed_edges(build_pairs(nodes, cfg, risk, crowd)))
    if lane_neighbors is not None:
        edges = lane_relations(edges, lane_neighbors, cfg)
    return edge_masks(kinematic_gate(edges, cfg))


def neighbour_features(nodes: DataFrame, edges: DataFrame, values: list[str], score: str) -> DataFrame:
    """Mean, max and softmax-weighted mean of source-node values over the kept in-edges of each node.

    Nodes without neighbours keep zeros. Columns: `<value>_nbr_mean`, `_nbr_max`, `_nbr_soft`.
    """
    msg = edges.where(F.col("message_passing")).select(
        "scenario_id", "src_track_id", F.col("dst_track_id").alias("track_id"), F.col(score).alias("_score"))
    src = nodes.select("scenario_id", F.col("track_id").alias("src_track_id"), *values)
    joined = msg.join(src, ["scenario_id", "src_track_id"])
    peak = joined.groupBy("scenario_id", "track_id").agg(F.max("_score").alias("_peak"))
    weighted = joined.join(peak, ["scenario_id", "track_id"]).withColumn("_w", F.exp(F.col("_score") - F.col("_peak")))
    pooled = weighted.groupBy("scenario_id", "track_id").agg(
        F.count("*").alias("num_neighbours"),
        *[F.avg(v).alias(f"{v}_nbr_mean") for v in values],
        *[F.max(v).alias(f"{v}_nbr_max") for v in values],
        *[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(f"{v}_nbr_soft") for v in values])
    fill = ["num_neighbours", *[f"{v}_nbr_{k}" for v in values for k in ("mean", "max", "soft")]]
    return nodes.select("scenario_id", "track_id", *values).join(
        pooled, ["scenario_id", "track_id"], "left").fillna(0, subset=fill)


def pair_embedding(edges: DataFrame, values: list[str]) -> DataFrame:
    """Adds src - dst and src * dst of the given node values (columns src_<v>, dst_<v>)."""
    return edges.withColumns({
        **{f"diff_{v}": F.col(f"src_{v}") - F.col(f"dst_{v}") for v in values},
        **{f"prod_{v}": F.col(f"src_{v}") * F.col(f"dst_{v}") for v in values}})
