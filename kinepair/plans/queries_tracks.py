"""Queries over track cleaning, features and lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinepair.config import MAP_RELATIONS
from kinepair.functions import series
from kinepair.functions.scalar import abs_angle_diff, angle_diff
from kinepair.operators import lanes, tracks
from kinepair.plans import fixtures, stages
from kinepair.plans.catalogue import listed, query, shown

KEY = ["scenario_id", "track_id"]


@query("t02_valid_frames", """select scenario_id, count(*) frames, count(*) filter (
  (observed and timestep between 0 and 49) or (not observed and timestep between 50 and 109)) valid_frames from frames group by 1""")
def t02(spark, d):
    return tracks.frame_validity(fixtures.frames(spark, d)).groupBy("scenario_id").agg(
        F.count("*").alias("frames"), F.count_if("valid").alias("valid_frames"))


@query("t03_aligned_grid", """select g.scenario_id, g.track_id, g.timestep t, round(f.position_x, 6) x, round(f.position_y, 6) y,
  f.position_x is not null valid from (select scenario_id, track_id, timestep from tracks cross join tsteps) g
  left join frames f on f.scenario_id = g.scenario_id and f.track_id = g.track_id and f.timestep = g.timestep""")
def t03(spark, d):
    both = tracks.gather_tracks(fixtures.frames(spark, d)).select(*KEY, F.map_from_entries(F.concat(
        F.transform("obs", lambda p: F.struct(p["t"], F.struct(p["x"].alias("x"), p["y"].alias("y")))),
        F.transform("fut", lambda p: F.struct(p["t"], F.struct(p["x"].alias("x"), p["y"].alias("y")))))).alias("m"))
    grid = both.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(109))))
    at = F.try_element_at("m", F.col("t"))
    return grid.select(*KEY, F.col("t").cast("bigint").alias("t"), F.round(at["x"], 6).alias("x"),
                       F.round(at["y"], 6).alias("y"), at.isNotNull().alias("valid"))


FILLED = ["x", "y", "vx", "vy"]


@query("t04_gap_fill", f"select {listed([*KEY, 'ok'], FILLED, ['t'])} from filled_all")
def t04(spark, d):
    p = stages.tracks_all(spark, d).select(*KEY, F.explode("path").alias("p")).select(*KEY, "p.*")
    return shown(p, [*KEY, "ok"], FILLED, ["t"])


@query("t05_heading_fill", """select scenario_id, track_id, cast(t as bigint) t, round(abs(cos(h)), 6) ch, round(abs(sin(h)), 6) sh
  from filled_all""")
def t05(spark, d):
    p = stages.tracks_all(spark, d).select(*KEY, F.explode("path").alias("p")).select(*KEY, "p.*")
    return p.select(*KEY, F.col("t").cast("bigint").alias("t"), F.round(F.abs(F.cos("h")), 6).alias("ch"),
                    F.round(F.abs(F.sin("h")), 6).alias("sh"))


@query("t06_jump_counts", """select scenario_id, track_id, name, j jumps from jumps""")
def t06(spark, d):
    t = tracks.unwrap_headings(tracks.gather_tracks(fixtures.frames(spark, d)))
    counts = F.array(*[F.struct(F.lit(k).alias("name"), series.jump_count(F.col("obs")[k], 5.0).cast("bigint").alias("jumps"))
                       for k in ("x", "y", "vx", "vy", "u")])
    return t.where(F.size("obs") > 0).select(*KEY, F.explode(counts).alias("c")).select(*KEY, "c.*")


@query("t07_track_quality", f"""select {listed([*KEY, 'skip_reason'], ['max_speed', 'max_acc'],
       ['num_observed', 'last_observed', 'pos_jumps', 'vel_jumps', 'heading_jumps'])} from quality""")
def t07(spark, d):
    q = tracks.track_quality(tracks.prepare_tracks(fixtures.frames(spark, d)))
    return shown(q, [*KEY, "skip_reason"], ["max_speed", "max_acc"],
                 ["num_observed", "last_observed", "pos_jumps", "vel_jumps", "heading_jumps"])


@query("t08_skip_counts", "select scenario_id, " + ", ".join(
    f"count(*) filter (skip_reason = '{s}') filter_{s}" for s in (
        "non_vehicle", "obs_too_short", "no_last_obs", "has_missing", "pos_jumps", "vel_jumps", "heading_jumps",
        "speed_extreme", "acc_extreme")) + " from quality group by 1")
def t08(spark, d):
    return tracks.skip_counts(stages.tracks_all(spark, d))


@query("t09_scenario_gate", """select s.scenario_id, coalesce(n.c, 0) num_nodes, coalesce(e.c, 0) num_edges,
  case when coalesce(n.c, 0) < 2 then 'fewer_than_two_nodes' when coalesce(e.c, 0) = 0 then 'no_eligible_edges' end reason,
  case when coalesce(n.c, 0) < 2 or coalesce(e.c, 0) = 0 then 'skipped' else 'built' end status
  from (select distinct scenario_id from tracks) s left join (select scenario_id, count(*) c from nodes group by 1) n using (scenario_id)
  left join (select scenario_id, count(*) c from pair_ids group by 1) e using (scenario_id)""")
def t09(spark, d):
    from kinepair.operators import manifest

    return manifest.scenario_status(stages.tracks_all(spark, d), stages.nodes(spark, d), stages.edges(spark, d))


@query("t10_relative_path", f"""select {listed([*KEY], ['rel_x', 'rel_y', 'speed'], ['t'])} from (
  select f.scenario_id, f.track_id, f.t, f.x - l.x rel_x, f.y - l.y rel_y, sqrt(f.vx*f.vx + f.vy*f.vy) speed
  from filled f join filled l on l.scenario_id = f.scenario_id and l.track_id = f.track_id and l.t = 49)""")
def t10(spark, d):
    p = stages.nodes(spark, d).select(*KEY, "cur_x", "cur_y", F.explode("path").alias("p"))
    return shown(p.select(*KEY, F.col("p.t").alias("t"), (F.col("p.x") - F.col("cur_x")).alias("rel_x"),
                          (F.col("p.y") - F.col("cur_y")).alias("rel_y"),
                          F.sqrt(F.col("p.vx") * F.col("p.vx") + F.col("p.vy") * F.col("p.vy")).alias("speed")),
                 KEY, ["rel_x", "rel_y", "speed"], ["t"])


@query("t11_acceleration", f"select {listed(KEY, ['norm'], ['t'])} from accel")
def t11(spark, d):
    a = tracks.prepare_tracks(fixtures.frames(spark, d)).select(*KEY, F.explode("acc").alias("a")).select(*KEY, "a.*")
    return shown(a, KEY, ["norm"], ["t"])


@query("t12_heading_rate_lateral", f"select {listed(KEY, ['lat_acc', 'rate'], ['t'])} from accel")
def t12(spark, d):
    a = tracks.prepare_tracks(fixtures.frames(spark, d)).select(*KEY, F.explode("acc").alias("a")).select(*KEY, "a.*")
    return shown(a.withColumnRenamed("lateral", "lat_acc"), KEY, ["lat_acc", "rate"], ["t"])


SUMMARY = ["speed_current", "speed_mean", "speed_std", "acc_std", "lateral_acc_std", "heading_rate_std", "observed_fraction"]


@query("t13_motion_summary", f"select {listed(KEY, SUMMARY)} from summary")
def t13(spark, d):
    return shown(stages.tracks_all(spark, d), KEY, SUMMARY)


@query("t14_node_vector", """select scenario_id, track_id, cast(358 as bigint) width, round(sum(v), 4) checksum from (
  select f.scenario_id, f.track_id, sum(f.x - l.x + f.y - l.y + f.vx + f.vy + sin(f.h) + cos(f.h) + case when f.ok then 1 else 0 end) v
  from filled f join filled l on l.scenario_id = f.scenario_id and l.track_id = f.track_id and l.t = 49 group by 1, 2
  union all select scenario_id, track_id, speed_current + speed_mean + speed_std + acc_std + lateral_acc_std + heading_rate_std
    + observed_fraction from nodes) group by 1, 2""")
def t14(spark, d):
    n = tracks.node_features(stages.nodes(spark, d))
    return n.select(*KEY, F.size("features").cast("bigint").alias("width"),
                    F.round(series.total(F.col("features")), 4).alias("checksum"))


@query("t15_scenario_labels", """select scenario_id, coalesce(min(city), 'unknown') city, '' focal_track_id,
  count(distinct city) num_cities from frames group by 1""")
def t15(spark, d):
    return tracks.scenario_labels(fixtures.frames(spark, d))


@query("t16_safe_slope", f"""select {listed(KEY, ['slope'])} from (select scenario_id, track_id,
  coalesce(regr_slope(x, t), 0) slope from obs group by 1, 2)""")
def t16(spark, d):
    t = tracks.gather_tracks(fixtures.frames(spark, d)).where(F.size("obs") > 0)
    return shown(t.select(*KEY, series.slope(F.col("obs"), "x").alias("slope")), KEY, ["slope"])


@query("t17_angle_diff", """select scenario_id, track_id, t, round(abs(d), 6) diff, round(cos(d), 6) cosine from (
  select scenario_id, track_id, timestep t, atan2(sin(heading - position_x), cos(heading - position_x)) d from frames)""")
def t17(spark, d):
    f = fixtures.frames(spark, d)
    return f.select(*KEY, F.col("timestep").alias("t"), F.round(abs_angle_diff(F.col("heading"), F.col("position_x")), 6).alias("diff"),
                    F.round(F.cos(angle_diff(F.col("heading"), F.col("position_x"))), 6).alias("cosine"))


def lane_documents(spark, d):
    """Map documents built from the lane view."""
    lane = fixtures.lane_points(spark, d).groupBy("scenario_id", "lane_id", "is_intersection", "left_neighbor_id", "right_neighbor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pt", "x", "y"))),
                    lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("centerline"))
    body = F.struct(F.col("lane_id").alias("id"), F.lit("VEHICLE").alias("lane_type"), "is_intersection", "centerline",
                    "left_neighbor_id", "right_neighbor_id", F.array().cast("array<bigint>").alias("predecessors"),
                    F.array().cast("array<bigint>").alias("successors"))
    return lane.groupBy("scenario_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("lane_id").cast("string"), body))).alias("lane_segments")).select(
        "scenario_id", F.to_json(F.struct("lane_segments")).alias("map_json"))


@query("s04_parse_lanes", "select scenario_id, lane_id, is_intersection, cast(pt as bigint) pt, x, y from lane_view")
def s04(spark, d):
    parsed = lanes.parse_lanes(lane_documents(spark, d))
    return lanes.lane_points(parsed).select("scenario_id", "lane_id", "is_intersection", F.col("pt").cast("bigint").alias("pt"), "x", "y")


@query("m01_lane_headings", "select scenario_id, lane_id, cast(pt as bigint) pt, round(heading, 6) heading from lane_pts")
def m01(spark, d):
    return stages.lane_points(spark, d).select("scenario_id", "lane_id", F.col("pt").cast("bigint").alias("pt"),
                                               F.round("heading", 6).alias("heading"))


@query("m02_lane_neighbors", "select scenario_id, src, dst, 'lateral' kind from lane_links where dst is not null")
def m02(spark, d):
    return lanes.lane_neighbors(lanes.parse_lanes(lane_documents(spark, d)))


LANE = ["lane_id", "lane_is_intersection"]


@query("m03_nearest_lane", f"select {listed([*KEY, *LANE], ['lane_distance', 'lane_heading'])} from nodes")
def m03(spark, d):
    n = tracks.keep_good(stages.tracks_all(spark, d))
    return shown(lanes.nearest_lane(n, stages.lane_points(spark, d)), [*KEY, *LANE], ["lane_distance", "lane_heading"])


REL = ["same_lane", "lateral_neighbor_lane", "connected_lane", "either_intersection", "map_candidate", "map_known", "map_unknown",
       "map_blocked"]
EDGE = ["scenario_id", "src_track_id", "dst_track_id"]


@query("m04_lane_relation", f"select {listed([*EDGE, *REL], ['lane_heading_diff'], ['map_relation_type'])} from lane_edge")
def m04(spark, d):
    return shown(stages.edges(spark, d), [*EDGE, *REL], ["lane_heading_diff"], ["map_relation_type"])


@query("m05_relation_names", "select city, case map_relation_type " + " ".join(
    f"when {k} then '{v}'" for k, v in MAP_RELATIONS.items()) + """ end relation, count(*) n from edges group by 1, 2""")
def m05(spark, d):
    return stages.edges(spark, d).groupBy("city", lanes.relation_name(F.col("map_relation_type")).alias("relation")).agg(
        F.count("*").alias("n"))


