"""Lane geometry and lane relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinepair.config import MAP_RELATIONS, BuildConfig
from kinepair.functions import series
from kinepair.functions.scalar import abs_angle_diff, finite
from kinepair.sources.staging import staged

LANE_JSON = (
    "lane_segments map<string, struct<id: string, lane_type: string, is_intersection: boolean,"
    " centerline: array<struct<x: string, y: string>>, left_neighbor_id: string, right_neighbor_id: string,"
    " predecessors: array<string>, successors: array<string>>>")


def parse_lanes(maps: DataFrame) -> DataFrame:
    """One row per usable lane from `scenario_id, map_json`.

    Keeps vehicle lanes (the default type) with at least two numeric points;
    an unreadable lane is dropped alone, an unreadable document gives no lanes.
    """
    lanes = maps.select("scenario_id", F.explode(F.from_json("map_json", LANE_JSON)["lane_segments"]).alias("raw", "lane"))
    pts = F.transform(F.col("lane.centerline"), lambda p: F.struct(
        p["x"].try_cast("double").alias("x"), p["y"].try_cast("double").alias("y")))
    ids = F.filter(F.array("lane.left_neighbor_id", "lane.right_neighbor_id"), lambda v: v.try_cast("bigint").isNotNull())
    links = F.filter(F.concat(F.coalesce("lane.predecessors", F.array()), F.coalesce("lane.successors", F.array())),
                     lambda v: v.try_cast("bigint").isNotNull())
    parsed = lanes.select(
        "scenario_id", F.coalesce(F.col("lane.id"), F.col("raw")).try_cast("bigint").alias("lane_id"),
        F.coalesce(F.col("lane.lane_type"), F.lit("VEHICLE")).alias("lane_type"),
        F.coalesce(F.col("lane.is_intersection"), F.lit(False)).alias("is_intersection"), pts.alias("pts"),
        F.array_distinct(F.transform(ids, lambda v: v.cast("bigint"))).alias("lateral"),
        F.array_distinct(F.transform(links, lambda v: v.cast("bigint"))).alias("topology"))
    good = (F.col("lane_id").isNotNull() & (F.col("lane_type") == "VEHICLE") & (F.size("pts") >= 2)
            & F.forall("pts", lambda p: F.coalesce(finite(p["x"]) & finite(p["y"]), F.lit(False))))
    return parsed.where(good).drop("lane_type")


def lane_points(lanes: DataFrame) -> DataFrame:
    """Long form with the heading at each point: to the next point, the last repeats the previous."""

    def headed(pts: Column) -> Column:
        def heading(i: Column) -> Column:
            j = F.least(i, F.size(pts) - 2)
            p, q = F.get(pts, j), F.get(pts, j + 1)
            return F.atan2(q["y"] - p["y"], q["x"] - p["x"])
        return F.transform(pts, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), heading(i).alias("heading")))

    return lanes.select("scenario_id", "lane_id", "is_intersection",
                        F.posexplode(series.bind(F.col("pts"), headed)).alias("pt", "_p")).select(
        "scenario_id", "lane_id", "is_intersection", "pt", "_p.*")


def lane_neighbors(lanes: DataFrame) -> DataFrame:
    """Distinct directed neighbour relations with kind `lateral` or `topology`."""
    both = F.concat(F.transform("lateral", lambda v: F.struct(v.alias("dst"), F.lit("lateral").alias("kind"))),
                    F.transform("topology", lambda v: F.struct(v.alias("dst"), F.lit("topology").alias("kind"))))
    return lanes.select("scenario_id", F.col("lane_id").alias("src"), F.explode(both).alias("_n")).select(
        "scenario_id", "src", "_n.dst", "_n.kind").distinct()


#: Side in metres of the finest cells of the occupancy pyramid, and its levels; each has twice the side of the one below.
CELL, LEVELS = 50.0, 24


def _best(joined: DataFrame, key: list[str]) -> DataFrame:
    """The nearest of the joined points of each node; ties go to the first lane and point."""
    dx, dy = F.col("x") - F.col("cur_x"), F.col("y") - F.col("cur_y")
    hit = F.struct(F.sqrt(dx * dx + dy * dy).alias("lane_distance"), F.col("lane_id"), F.col("pt"),
                   F.col("heading").alias("lane_heading"), F.col("is_intersection").alias("lane_is_intersection"))
    return joined.groupBy(*key).agg(F.min(hit).alias("_hit"))


def _cell(c: Column, side: float | Column = CELL) -> Column:
    return F.floor(c / (F.lit(float(side)) if isinstance(side, float) else side)).cast("bigint")


def _around(axis: str, reach: Column, side: Column) -> Column:
    return F.explode(F.sequence(_cell(F.col(axis) - reach, side), _cell(F.col(axis) + reach, side)))


def _far_cells(rest: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """For each node the finest cells that may hold its nearest point: (key, cur_x, cur_y, _cx, _cy).

    The pyramid counts a cell as occupied at a level if any cell within it is. A node's level is the lowest at which its
    own cell or one of the eight around it is occupied; then a point lies within two cell diagonals, which is the node's own search
    radius. The cells within it are read off that level, and those whose nearest corner is farther than the farthest corner of another one go.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level")
    up = lambda c: F.expr(f"shiftright({c}, _level)")
    pyramid = cells.select("*", levels).select("scenario_id", "_level", up("_cx").alias("_px"), up("_cy").alias("_py"), "_cx", "_cy")
    step = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    near = pyramid.select("scenario_id", "_level", "_px", "_py").distinct().withColumn("_dx", step).withColumn("_dy", step).select(
        "scenario_id", "_level", (F.col("_px") + F.col("_dx")).alias("_px"), (F.col("_py") + F.col("_dy")).alias("_py")).distinct()
    own = rest.select(*key, "cur_x", "cur_y", levels).withColumns({"_px": F.expr("shiftright(" + f"cast(floor(cur_x / {CELL}) as bigint), _level)"),
                                                                    "_py": F.expr("shiftright(" + f"cast(floor(cur_y / {CELL}) as bigint), _level)")})
    found = own.join(near, ["scenario_id", "_level", "_px", "_py"]).groupBy(*key).agg(F.min("_level").alias("_level"), F.first("cur_x").alias("cur_x"), F.first("cur_y").alias("cur_y"))
    sided = found.withColumn("_side", F.lit(CELL) * F.pow(F.lit(2.0), "_level")).withColumn("_reach", F.lit(2 * math.sqrt(2.0)) * F.col("_side"))
    asked = sided.withColumn("_px", _around("cur_x", F.col("_reach"), F.col("_side"))).withColumn("_py", _around("cur_y", F.col("_reach"), F.col("_side")))
    held = asked.join(pyramid, ["scenario_id", "_level", "_px", "_py"])

    def apart(c: str, cell: str) -> tuple[Column, Column]:
        low = F.col(cell) * F.lit(CELL)
        inside = F.greatest(low - F.col(c), F.col(c) - (low + F.lit(CELL)), F.lit(0.0))
        return inside, F.greatest(F.abs(F.col(c) - low), F.abs(F.col(c) - (low + F.lit(CELL))))

    (nx, fx), (ny, fy) = apart("cur_x", "_cx"), apart("cur_y", "_cy")
    measured = held.withColumns({"_near": F.sqrt(nx * nx + ny * ny), "_far": F.sqrt(fx * fx + fy * fy)})
    # A little slack, as the distances of points are rounded on their own.
    bound = F.min("_far").over(W.partitionBy(*key)) * F.lit(1 + 1e-9)
    return measured.withColumn("_bound", bound).where("_near <= _bound").select(*key, "cur_x", "cur_y", "_cx", "_cy")


def nearest_lane(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Adds the nearest lane point of the same scenario: id, distance, heading, intersection flag.

    Ties go to the first lane and point. Points within CELL metres are found through grid cells of that size, and the result is written.
    Only for nodes without one a pyramid of occupied cells gives a search radius to each, and again points are joined by
    their cells, so the result is exact at any distance and no node meets the whole map. Only ids and coordinates take part; the result is
    joined back. A scenario without lanes, and a node without finite position, gives NULL lane id and distance, heading 0 and no intersection.
    """
    key = ["scenario_id", "track_id"]
    placed = nodes.where(finite(F.col("cur_x")) & finite(F.col("cur_y"))).select(*key, "cur_x", "cur_y")
    gridded = points.withColumns({"_cx": _cell(F.col("x")), "_cy": _cell(F.col("y"))})
    reach, side = F.lit(CELL), F.lit(CELL)
    spread = placed.withColumn("_cx", _around("cur_x", reach, side)).withColumn("_cy", _around("cur_y", reach, side))
    close = staged(_best(spread.join(gridded, ["scenario_id", "_cx", "_cy"]), key).where(F.col("_hit.lane_distance") <= F.lit(CELL)), "lanes-close")
    rest = staged(placed.join(close, key, "left_anti"), "lanes-rest")
    cells = gridded.select("scenario_id", "_cx", "_cy").distinct()
    far = _best(_far_cells(rest, cells, key).join(gridded, ["scenario_id", "_cx", "_cy"]), key)
    found = close.unionByName(far)
    found = found.select(*key, "_hit.lane_id", "_hit.lane_distance", "_hit.lane_heading", "_hit.lane_is_intersection")
    return nodes.join(found, key, "left").fillna({"lane_heading": 0.0, "lane_is_intersection": False})


def lane_relations(edges: DataFrame, neighbors: DataFrame, cfg: BuildConfig = BuildConfig()) -> DataFrame:
    """Adds the lane-pair relation of directed edges and `map_candidate`, the only hard gate.

    A missing or distant lane is ambiguous, never a reason for exclusion.
    """
    c = F.col
    # Both directions of a relation count, so the lookup is made symmetric once.
    flat = neighbors.select("scenario_id", c("src").alias("src_lane_id"), c("dst").alias("dst_lane_id"), "kind")
    turned = neighbors.select("scenario_id", c("dst").alias("src_lane_id"), c("src").alias("dst_lane_id"), "kind")
    known_lanes = flat.unionByName(turned).groupBy("scenario_id", "src_lane_id", "dst_lane_id").agg(
        F.max((c("kind") == "lateral").cast("int")).alias("_lat"), F.max((c("kind") == "topology").cast("int")).alias("_top"))
    df = edges.join(known_lanes, ["scenario_id", "src_lane_id", "dst_lane_id"], "left")

    def known(side: str) -> Column:
        return F.coalesce(c(f"{side}_lane_distance") <= cfg.lane_max_distance_m, F.lit(False))

    df = df.withColumn("map_known", known("src") & known("dst"))
    df = df.withColumns({
        "same_lane": c("map_known") & (c("src_lane_id") == c("dst_lane_id")),
        "lateral_neighbor_lane": c("map_known") & F.coalesce(c("_lat") == 1, F.lit(False)),
        "connected_lane": c("map_known") & F.coalesce(c("_top") == 1, F.lit(False)),
        "lane_heading_diff": abs_angle_diff(c("src_lane_heading"), c("dst_lane_heading")),
        "either_intersection": c("src_lane_is_intersection") | c("dst_lane_is_intersection"),
    }).drop("_lat", "_top")
    low, high = math.radians(cfg.perpendicular_lane_min_deg), math.radians(cfg.perpendicular_lane_max_deg)
    blocked = (c("lane_heading_diff").between(low, high)
               & (c("d_current") > cfg.candidate_perpendicular_min_distance_m))
    relation = (F.when(~c("map_known"), 0).when(c("same_lane"), 1).when(c("lateral_neighbor_lane"), 2)
                .when(c("connected_lane"), 3).when(c("either_intersection"), 4).when(blocked, 6).otherwise(5))
    return df.withColumn("map_relation_type", relation).withColumns({
        "map_candidate": c("map_relation_type") != 6,
        "map_unknown": ~c("map_known"),
        "map_blocked": c("map_relation_type") == 6,
    })


def relation_name(code: Column) -> Column:
    pairs = [F.lit(v) for item in MAP_RELATIONS.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), code)
