"""Queries over pairs, edge features, risk labels and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinepair.config import EDGE_FEATURES, RESIDUAL_FEATURES, RiskConfig
from kinepair.operators import manifest, pairs, risk
from kinepair.plans import fixtures, stages
from kinepair.plans.catalogue import listed, query, r6, shown
from kinepair.plans.oracle_views import r
from kinepair.sources.staging import staged, tune

EDGE = ["scenario_id", "src_track_id", "dst_track_id"]
PAIR = ["scenario_id", "a_track_id", "b_track_id"]


@query("g01_radius_join", f"""select scenario_id, src a_track_id, dst b_track_id, {r('d')} d from (
  select e.*, sqrt((b.cur_x-a.cur_x)*(b.cur_x-a.cur_x) + (b.cur_y-a.cur_y)*(b.cur_y-a.cur_y)) d from pair_ids e
  join nodes a on a.scenario_id = e.scenario_id and a.track_id = e.src join nodes b on b.scenario_id = e.scenario_id and b.track_id = e.dst)
  where src < dst""")
def g01(spark, d):
    n = stages.nodes(spark, d).select("scenario_id", "track_id", "cur_x", "cur_y")
    p = pairs.radius_pairs(n, 60.0)
    dx, dy = F.col("b_cur_x") - F.col("a_cur_x"), F.col("b_cur_y") - F.col("a_cur_y")
    return p.select(*PAIR, r6(F.sqrt(dx * dx + dy * dy)).alias("d"))


@query("g02_dense_ids", """select scenario_id, src_track_id, dst_track_id, cast(edge_id as bigint) edge_id,
  cast(src_node_id as bigint) src_node_id, cast(dst_node_id as bigint) dst_node_id from edges""")
def g02(spark, d):
    return shown(stages.edges(spark, d), EDGE, whole=["edge_id", "src_node_id", "dst_node_id"])


@query("g03_pair_frames", f"select {listed(['scenario_id', 'src a_track_id', 'dst b_track_id'], ['d', 'c'], ['t'])} from hist where src < dst")
def g03(spark, d):
    f = pairs.pair_frames(stages.joined_pairs(spark, d)).where("t < 50 and d is not null")
    return shown(f, PAIR, ["d", "c"], ["t"])


@query("g04_edge_features", f"select {listed(EDGE, list(EDGE_FEATURES))} from feat")
def g04(spark, d):
    return shown(stages.edges(spark, d), EDGE, list(EDGE_FEATURES))


FUTURE = ["future_min_timestep", "pair_future_count", "future_first_valid_timestep", "future_last_valid_timestep", "future_valid_span"]


@query("g05_future_minimum", f"select {listed(EDGE, ['future_min_distance', 'future_valid_fraction'], FUTURE)} from futmin")
def g05(spark, d):
    p = pairs.summarise_pairs(stages.joined_pairs(spark, d), parts=("future",))
    return shown(pairs.directed_edges(p), EDGE, ["future_min_distance", "future_valid_fraction"], FUTURE)


GATE = ["kinematic_near", "kinematic_dynamic", "kinematic_far_receding", "kinematic_candidate"]


@query("g06_kinematic_gate", f"select {', '.join([*EDGE, *GATE])} from gate")
def g06(spark, d):
    return stages.edges(spark, d).select(*EDGE, *GATE)


MASKS = ["raw_edge", "physical_possible", "message_passing", "task_candidate", "hard_pruned", "soft_task_excluded", "supervision",
         "label_computable", "label_strict"]


@query("g07_mask_lattice", f"select {', '.join([*EDGE, *MASKS])} from edges")
def g07(spark, d):
    return stages.edges(spark, d).select(*EDGE, *MASKS)


@query("g08_proximity_labels", """select city, count(*) edges, cast(sum(label_proximity) as bigint) proximity,
  cast(sum(label_risk) as bigint) risk from edges group by 1""")
def g08(spark, d):
    return stages.edges(spark, d).groupBy("city").agg(
        F.count("*").alias("edges"), F.sum("label_proximity").alias("proximity"), F.sum("label_risk").alias("risk"))


MANIFEST_SQL = {"scenario_counts": """select *, pp / greatest(raw, 1) physical_possible_retention_rate,
    tc / greatest(raw, 1) task_candidate_retention_rate, prox / greatest(comp, 1) proximity_positive_rate,
    rk / greatest(comp, 1) risk_positive_rate, cand_prox / greatest(prox, 1) task_positive_recall,
    (prox - hard_prox) / greatest(prox, 1) physical_positive_recall from (
  select e.scenario_id, e.city, count(*) num_edges, count(*) raw, count(*) filter (physical_possible) pp, count(*) filter (task_candidate) tc,
    count(*) filter (soft_task_excluded) soft, count(*) filter (label_computable) comp, count(*) filter (supervision) sup,
    count(*) filter (label_proximity = 1) prox, count(*) filter (label_risk = 1) rk,
    count(*) filter (task_candidate and label_computable) cand_comp,
    count(*) filter (task_candidate and label_computable and label_proximity = 1) cand_prox,
    count(*) filter (hard_pruned and label_computable and label_proximity = 1) hard_prox,
    count(*) filter (map_known) known, count(*) filter (same_lane) same, count(*) filter (lateral_neighbor_lane) lat,
    count(*) filter (either_intersection) inter, avg(d_current) mean_d_current,
    coalesce(avg(future_min_distance) filter (label_computable), 0) mean_future_min_distance,
    any_value(n.c) num_nodes, any_value(n.l) num_nearest_lanes, cast(4 as bigint) num_lanes
  from edges e join (select scenario_id, count(*) c, count(distinct lane_id) l from nodes group by 1) n using (scenario_id) group by 1, 2)"""}
COUNT_NAMES = {
    "num_raw_edges": "raw", "num_physical_possible_edges": "pp", "num_task_candidate_edges": "tc", "num_soft_task_excluded_edges": "soft",
    "num_label_computable_edges": "comp", "num_supervision_edges": "sup", "num_proximity_positive_edges": "prox",
    "num_risk_positive_edges": "rk", "num_interaction_candidate_computable_edges": "cand_comp",
    "num_interaction_candidate_proximity_positive_edges": "cand_prox", "num_hard_pruned_proximity_positive_edges": "hard_prox",
    "num_map_known_edges": "known", "num_same_lane_edges": "same", "num_lateral_neighbor_lane_edges": "lat", "num_intersection_edges": "inter"}
RATES = ["physical_possible_retention_rate", "task_candidate_retention_rate", "proximity_positive_rate", "risk_positive_rate",
         "task_positive_recall", "physical_positive_recall"]
MEANS = ["mean_d_current", "mean_future_min_distance"]
PLAIN = ["num_edges", "num_nodes", "num_nearest_lanes", "num_lanes"]


def scenario_table(spark, d):
    return manifest.scenario_counts(stages.nodes(spark, d), stages.edges(spark, d), fixtures.lane_points(spark, d))


@query("g09_scenario_manifest", f"""select scenario_id, city, {', '.join(PLAIN)}, {', '.join(f'{v} {k}' for k, v in COUNT_NAMES.items())},
  {', '.join(f'{r(c)} {c}' for c in RATES + MEANS)} from scenario_counts""", MANIFEST_SQL)
def g09(spark, d):
    return shown(scenario_table(spark, d), ["scenario_id", "city"], RATES + MEANS, [*PLAIN, *COUNT_NAMES])


@query("g10_corpus_summary", f"""select case when grouping(city) = 1 then 'total' else 'city' end scope, city, count(*) num_graphs, cast(sum(num_nodes) as bigint) num_nodes, cast(sum(num_edges) as bigint) num_edges,
  {', '.join(f'cast(sum({v}) as bigint) {k}' for k, v in COUNT_NAMES.items())}, {r('sum(pp) / greatest(sum(raw), 1)')} physical_possible_retention_rate,
  {r('sum(prox) / greatest(sum(comp), 1)')} proximity_positive_rate from scenario_counts group by grouping sets ((), (city))""", MANIFEST_SQL)
def g10(spark, d):
    s = manifest.corpus_summary(scenario_table(spark, d))
    return shown(s, ["scope", "city"], ["physical_possible_retention_rate", "proximity_positive_rate"],
                 ["num_graphs", "num_nodes", "num_edges", *COUNT_NAMES])


@query("g12_reverse_edges", """select e.scenario_id, e.src_track_id, e.dst_track_id, cast(e.edge_id as bigint) edge_id,
  cast(coalesce(b.edge_id, -1) as bigint) reverse_edge_id from edges e left join edges b on b.scenario_id = e.scenario_id
  and b.src_track_id = e.dst_track_id and b.dst_track_id = e.src_track_id""")
def g12(spark, d):
    e = stages.edges(spark, d).select(*EDGE, "edge_id")
    return shown(pairs.reverse_edges(e, "src_track_id", "dst_track_id"), EDGE, whole=["edge_id", "reverse_edge_id"])


@query("g13_motion_residual", f"select {listed(EDGE, list(RESIDUAL_FEATURES))} from feat")
def g13(spark, d):
    p = pairs.summarise_pairs(stages.joined_pairs(spark, d), parts=("residual",))
    return shown(pairs.directed_edges(p), EDGE, list(RESIDUAL_FEATURES))


@query("g15_neighbour_features", f"""select n.scenario_id, n.track_id, coalesce(m.c, 0) num_neighbours, {r('coalesce(m.mean, 0)')} speed_mean_nbr_mean,
  {r('coalesce(m.mx, 0)')} speed_mean_nbr_max, {r('coalesce(m.soft, 0)')} speed_mean_nbr_soft from nodes n left join (
  select e.scenario_id, e.dst_track_id track_id, count(*) c, avg(s.speed_mean) mean, max(s.speed_mean) mx,
    sum(exp(-e.d_current/10) * s.speed_mean) / sum(exp(-e.d_current/10)) soft
  from edges e join nodes s on s.scenario_id = e.scenario_id and s.track_id = e.src_track_id where e.message_passing group by 1, 2) m
  using (scenario_id, track_id)""")
def g15(spark, d):
    e = stages.edges(spark, d).withColumn("closeness", -F.col("d_current") / 10)
    n = pairs.neighbour_features(stages.nodes(spark, d), e, ["speed_mean"], "closeness")
    return shown(n, ["scenario_id", "track_id"], ["speed_mean_nbr_mean", "speed_mean_nbr_max", "speed_mean_nbr_soft"], ["num_neighbours"])


def risk_steps(spark, d):
    return risk.risk_steps(pairs.pair_frames(stages.joined_pairs(spark, d))).where("t >= 50 and d is not null")


@query("r02_contiguous_runs", """select scenario_id, src a_track_id, dst b_track_id, count(distinct island) runs, max(n) longest from (
  select *, count(*) over (partition by scenario_id, src, dst, island) n from risk_islands) where src < dst group by 1, 2, 3""")
def r02(spark, d):
    steps = pairs.pair_frames(stages.joined_pairs(spark, d)).where("t >= 50 and d is not null")
    mask = steps.groupBy(*PAIR).agg(F.bit_or(F.expr("shiftleft(1L, t - 50)")).alias("m"))
    runs = F.size(F.filter(F.split(F.bin("m"), "0"), lambda s: F.length(s) > 0))
    return mask.select(*PAIR, runs.cast("bigint").alias("runs"), risk.longest_run(F.col("m")).cast("bigint").alias("longest"))


@query("r03_closing_speed", f"""select scenario_id, src a_track_id, dst b_track_id, cast(t as bigint) t, {r('d')} d, {r('c')} closing
  from risk_speed where src < dst and c is not null""")
def r03(spark, d):
    return shown(risk_steps(spark, d).where("closing is not null"), PAIR, ["d", "closing"], ["t"])


@query("r04_longest_run", """select scenario_id, src_track_id a_track_id, dst_track_id b_track_id, cast(violation_run_max as bigint) violation_run_max
  from risk where src_track_id < dst_track_id""")
def r04(spark, d):
    return shown(risk.dynamic_risk(stages.joined_pairs(spark, d)), PAIR, whole=["violation_run_max"])


RISK_N = ["dynamic_margin_min", "closing_speed_at_risk", "threshold_at_risk"]
RISK_W = ["label_dynamic_risk", "dynamic_risk_step", "violation_run_max"]


@query("r06_dynamic_risk", f"select {listed([*EDGE, 'dynamic_computable'], RISK_N, RISK_W)} from risk")
def r06(spark, d):
    p = risk.dynamic_risk(stages.joined_pairs(spark, d))
    return shown(pairs.directed_edges(p), [*EDGE, "dynamic_computable"], RISK_N, RISK_W)


@query("r08_selected_computable", "select scenario_id, src_track_id, dst_track_id, label_computable and dynamic_computable selected_computable from edges")
def r08(spark, d):
    return risk.selected_computable(stages.edges(spark, d)).select(*EDGE, "selected_computable")


GRID = [RiskConfig(risk_base_distance_m=b, risk_reaction_time_s=t) for b in (3.0, 5.0) for t in (0.5, 1.5)]


@query("r09_param_grid", f"""select scenario_id, src_track_id a_track_id, dst_track_id b_track_id, base risk_base_distance_m,
  reaction risk_reaction_time_s, cast(label_dynamic_risk as bigint) label_dynamic_risk, {r('dynamic_margin_min')} dynamic_margin_min
  from risk where src_track_id < dst_track_id""", {"risk_params": "select * from (values " + ", ".join(
    f"({c.risk_base_distance_m}::double, {c.risk_reaction_time_s}::double, 4.0::double)" for c in GRID) + ") v(base, reaction, decel)"})
def r09(spark, d):
    g = risk.risk_grid(stages.joined_pairs(spark, d), GRID)
    return shown(g, [*PAIR, "risk_base_distance_m", "risk_reaction_time_s"], ["dynamic_margin_min"], ["label_dynamic_risk"])


RUNS = [RiskConfig(risk_base_distance_m=b, min_risk_consecutive_frames=n) for b in (3.0, 8.0) for n in (1, 3, 5)]


@query("r09b_run_length_grid", f"""select e.scenario_id, e.src a_track_id, e.dst b_track_id, e.base risk_base_distance_m, cast(e.run as bigint) min_risk_consecutive_frames,
  cast(coalesce(vbest >= e.run and bbest >= e.run, false) as bigint) label_dynamic_risk, {r('case when vbest >= e.run then (case when bbest >= e.run then qual else every end) end')} dynamic_margin_min,
  cast(case when vbest >= e.run then bbest else 0 end as bigint) violation_run_max
  from (select * from pair_ids cross join risk_params cross join (select unnest([1, 3, 5]) run) where src < dst) e
  left join (select scenario_id, src, dst, base, run, max(vlen) vbest, coalesce(max(len) filter (bad), 0) bbest, min(m) every, min(m) filter (bad and len >= run) qual
    from risk_runs cross join (select unnest([1, 3, 5]) run) group by all) x using (scenario_id, src, dst, base, run)""",
       {"risk_params": "select * from (values (3.0::double, 1.0::double, 4.0::double), (8.0::double, 1.0::double, 4.0::double)) v(base, reaction, decel)"})
def r09b(spark, d):
    g = risk.risk_grid(stages.joined_pairs(spark, d), RUNS)
    return shown(g, [*PAIR, "risk_base_distance_m"], ["dynamic_margin_min"], ["min_risk_consecutive_frames", "label_dynamic_risk", "violation_run_max"])


@query("flagship_risk_by_city", f"""select city, count(*) edges, cast(sum(label_dynamic_risk) as bigint) positive_edges,
  {r('avg(label_dynamic_risk)')} positive_rate from feat join risk using (scenario_id, src_track_id, dst_track_id) group by 1""")
def flagship(spark, d):
    return risk_by_city(spark, d)


def risk_by_city(spark, d):
    """Frames to pairs to dynamic risk, per city."""
    from kinepair.operators import tracks

    # The nodes feed both sides of the join, so they are written once, with what the labels need.
    built = tracks.build_nodes(fixtures.frames(tune(spark), d))
    n = staged(built.select("scenario_id", "city", "track_id", "cur_x", "cur_y", "future"), "nodes")
    e = pairs.directed_edges(risk.dynamic_risk(pairs.join_pairs(n)))
    return e.groupBy("city").agg(F.count("*").alias("edges"), F.sum("label_dynamic_risk").alias("positive_edges"),
                                 r6(F.avg("label_dynamic_risk")).alias("positive_rate"))
