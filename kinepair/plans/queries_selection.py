"""Queries over pair selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinepair import config as cfg
from kinepair.operators import audit, selection
from kinepair.plans import stages
from kinepair.plans.catalogue import query, r6, shown
from kinepair.plans.oracle_views import VIEWS, r

SEED = 20260621
EDGE = ["scenario_id", "src_track_id", "dst_track_id"]
PAIR = ["scenario_id", "pair_lo", "pair_hi"]

VIEWS["win"] = """select scenario_id, track_id, bool_and(ok) contiguous, avg(sqrt(vx*vx + vy*vy)) speed from filled where t between 39 and 49 group by 1, 2"""
VIEWS["scenario_split"] = """select scenario_id, case when h < 7 then 'train' when h < 8 then 'val' else 'test' end split
  from (select distinct scenario_id, cast('0x' || substr(sha256(scenario_id), 1, 4) as integer) % 10 h from nodes)"""
VIEWS["ready"] = """select e.*, a.contiguous src_contiguous, b.contiguous dst_contiguous, b.speed dst_window_speed, s.split from edges e
  join scenario_split s on s.scenario_id = e.scenario_id and s.split = 'train'
  join win a on a.scenario_id = e.scenario_id and a.track_id = e.src_track_id join win b on b.scenario_id = e.scenario_id and b.track_id = e.dst_track_id"""
VIEWS["negative"] = """select * from ready where supervision and label_computable and dynamic_computable and physical_possible and label_dynamic_risk = 0"""
VIEWS["oriented"] = """select n.*, m.edge_id reverse_edge_id, least(n.src_track_id, n.dst_track_id) pair_lo, greatest(n.src_track_id, n.dst_track_id) pair_hi
  from negative n join negative m on m.scenario_id = n.scenario_id and m.src_track_id = n.dst_track_id and m.dst_track_id = n.src_track_id
  where n.dst_contiguous and n.src_cur_ok and n.dst_cur_ok"""
VIEWS["chosen_end"] = """select *, count(*) over (partition by scenario_id, pair_lo, pair_hi) orientation_candidate_count from oriented
  qualify row_number() over (partition by scenario_id, pair_lo, pair_hi order by dst_window_speed, dst_track_id, src_track_id, edge_id) = 1"""
VIEWS["seeded"] = f"""select * from chosen_end qualify row_number() over (partition by scenario_id
  order by sha256('{SEED}:' || scenario_id || ':' || pair_lo || ':' || pair_hi), pair_lo, pair_hi) = 1"""
VIEWS["sampled"] = f"""select * exclude (rk, n) from (select *, row_number() over (order by sha256('{SEED}:' || scenario_id), scenario_id) rk, count(*) over () n
  from seeded) where rk <= greatest(round_even(n * 0.3, 0), 1)"""
VIEWS["both_ends"] = """select *, least(src_speed_current, dst_speed_current) min_speed from (select o.*, count(*) over (partition by scenario_id, pair_lo, pair_hi) orientation_candidate_count
  from oriented o where src_contiguous and dst_contiguous and label_strict and exists (select 1 from edges m where m.scenario_id = o.scenario_id
    and m.edge_id = o.reverse_edge_id and m.label_strict))
  qualify row_number() over (partition by scenario_id, pair_lo, pair_hi order by dst_window_speed, dst_track_id, src_track_id, edge_id) = 1"""
VIEWS["regimes"] = f"""select *, sha256(concat_ws(':', 'pair-priority-v1', '{SEED}', scenario_id, motion_regime, pair_lo, pair_hi)) selection_priority_sha256
  from (select *, case when min_speed < 0.5 then 'slow_lt_0p5' else 'moving_ge_0p5' end motion_regime from both_ends)"""
VIEWS["preferred"] = """select * from regimes qualify row_number() over (partition by scenario_id order by motion_regime <> 'slow_lt_0p5',
  selection_priority_sha256, pair_lo, pair_hi) = 1"""



def scenario_splits(spark, d):
    """Seven scenarios in ten are for training, one for validation, two for test."""
    part = F.conv(F.substring(F.sha2("scenario_id", 256), 1, 4), 16, 10).cast("int") % 10
    return stages.nodes(spark, d).select("scenario_id").distinct().withColumn(
        "split", F.when(part < 7, "train").when(part < 8, "val").otherwise("test"))


def ready_edges(spark, d):
    e = selection.in_split(stages.edges(spark, d), scenario_splits(spark, d))
    return selection.with_windows(e, selection.node_windows(stages.nodes(spark, d)))


def oriented(spark, d):
    return selection.orient_pairs(selection.eligible_orientations(ready_edges(spark, d)))


def seeded(spark, d):
    return selection.seeded_pair(oriented(spark, d), SEED)


def base(spark, d):
    return selection.base_manifest(ready_edges(spark, d), 0.3, SEED)


def candidates(spark, d):
    return selection.regime_candidates(ready_edges(spark, d), SEED)


@query("h01_supervision_mask", """select city, count(*) filter (supervision and label_computable) supervised,
  count(*) filter (supervision and label_computable and label_strict) strict from edges group by 1""")
def h01(spark, d):
    return stages.edges(spark, d).groupBy("city").agg(
        F.count_if(selection.supervision_mask()).alias("supervised"), F.count_if(selection.supervision_mask(True)).alias("strict"))


@query("h02_contiguous_edges", "select scenario_id, src_track_id, dst_track_id from ready where dst_contiguous and src_cur_ok and dst_cur_ok")
def h02(spark, d):
    return ready_edges(spark, d).where("dst_contiguous and src_cur_ok and dst_cur_ok").select(*EDGE)


@query("h03_eligible_edges", "select scenario_id, src_track_id, dst_track_id from negative where dst_contiguous and src_cur_ok and dst_cur_ok")
def h03(spark, d):
    return ready_edges(spark, d).where(selection.oriented_edge()).select(*EDGE)


@query("h04_eligible_pairs", "select scenario_id, pair_lo, pair_hi, count(*) orientations from oriented group by 1, 2, 3")
def h04(spark, d):
    return selection.eligible_orientations(ready_edges(spark, d)).groupBy(*PAIR).agg(F.count("*").alias("orientations"))


@query("h05_window_speed", f"select scenario_id, track_id, contiguous, {r('case when contiguous then speed else -1 end')} window_speed from win")
def h05(spark, d):
    w = selection.node_windows(stages.nodes(spark, d)).select("scenario_id", "track_id", "contiguous", F.coalesce("window_speed", F.lit(-1.0)).alias("window_speed"))
    return shown(w, ["scenario_id", "track_id", "contiguous"], ["window_speed"])


@query("h06_orientation", f"select scenario_id, pair_lo, pair_hi, dst_track_id, orientation_candidate_count, {r('dst_window_speed')} dst_window_speed from chosen_end")
def h06(spark, d):
    return shown(oriented(spark, d), [*PAIR, "dst_track_id", "orientation_candidate_count"], ["dst_window_speed"])


@query("h07_scenario_sample", "select scenario_id, pair_lo, pair_hi from sampled")
def h07(spark, d):
    return selection.sample_scenarios(seeded(spark, d), 0.3, SEED).select(*PAIR)


@query("h08_seeded_pair", "select scenario_id, pair_lo, pair_hi, src_track_id, dst_track_id from seeded")
def h08(spark, d):
    return seeded(spark, d).select(*PAIR, "src_track_id", "dst_track_id")


@query("h09_motion_regime", f"select scenario_id, pair_lo, pair_hi, motion_regime, {r('min_speed')} min_endpoint_speed_mps from regimes")
def h09(spark, d):
    return shown(candidates(spark, d), [*PAIR, "motion_regime"], ["min_endpoint_speed_mps"])


@query("h10_pair_priority", "select scenario_id, pair_lo, pair_hi, selection_priority_sha256 from regimes")
def h10(spark, d):
    return candidates(spark, d).select(*PAIR, "selection_priority_sha256")


@query("h11_preferred_pair", "select scenario_id, pair_lo, pair_hi, motion_regime from preferred")
def h11(spark, d):
    return selection.preferred_pair(candidates(spark, d), cfg.SLOW_REGIME).select(*PAIR, "motion_regime")


@query("h12_regime_change", f"""select count(*) scenarios, count(*) filter (base_regime = 'slow_lt_0p5') base_slow, count(*) filter (base_regime = 'moving_ge_0p5') base_moving,
  count(*) filter (motion_regime = 'slow_lt_0p5') selected_slow, count(*) filter (motion_regime = 'moving_ge_0p5') selected_moving,
  count(*) filter (mv) with_moving_candidate, count(*) filter (sl) with_slow_candidate, cast(sum(n) as bigint) candidate_pairs,
  count(*) filter (changed) changed_pairs, {r('avg(case when changed then 1.0 else 0.0 end)')} changed_pair_rate from (
  select p.motion_regime, case when least(b.src_speed_current, b.dst_speed_current) < 0.5 then 'slow_lt_0p5' else 'moving_ge_0p5' end base_regime,
    s.mv, s.sl, s.n, p.pair_lo <> b.pair_lo or p.pair_hi <> b.pair_hi changed from preferred p join sampled b using (scenario_id)
  join (select scenario_id, bool_or(motion_regime = 'moving_ge_0p5') mv, bool_or(motion_regime = 'slow_lt_0p5') sl, count(*) n from regimes group by 1) s using (scenario_id))""")
def h12(spark, d):
    m = selection.regime_manifest(candidates(spark, d), base(spark, d), SEED, cfg.SLOW_REGIME)
    out = selection.regime_change(m)
    return out.withColumn("changed_pair_rate", r6("changed_pair_rate"))


@query("h13_base_manifest", f"select scenario_id, src_track_id, dst_track_id, cast(src_node_id as bigint) src, cast(dst_node_id as bigint) dst, split, {SEED} seed, 'minimum_jerk' ramp_style from sampled")
def h13(spark, d):
    m = base(spark, d)
    return m.select(*EDGE, F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "split", "seed", "ramp_style")


@query("h13b_manifest_volume", f"""select (select count(distinct scenario_id) from oriented) eligible_scenarios, (select count(*) from chosen_end) eligible_negative_pairs,
  (select count(*) from oriented) eligible_orientations, (select count(*) from ready where supervision and label_computable and dynamic_computable) supervised_edges,
  (select count(*) from sampled) selected_pairs, {r('(select count(*) from sampled) / (select count(distinct scenario_id) from oriented)')} realized_scenario_rate""")
def h13b(spark, d):
    v = selection.manifest_volume(ready_edges(spark, d), base(spark, d))
    return shown(v, ["eligible_scenarios", "eligible_negative_pairs", "eligible_orientations", "supervised_edges", "selected_pairs"], ["realized_scenario_rate"])


@query("h14_window_schedule", f"select scenario_id, motion_regime, case motion_regime when 'slow_lt_0p5' then 10 else 4 end perturb_window, '{cfg.SCHEDULE_ID}' trigger_schedule_id from preferred")
def h14(spark, d):
    m = selection.fixed_fields(selection.preferred_pair(candidates(spark, d), cfg.SLOW_REGIME), SEED)
    return selection.schedule(m).select("scenario_id", "motion_regime", "perturb_window", "trigger_schedule_id")


VIEWS["alloc"] = """select scenario_id, src_node_id src, dst_node_id dst, src_track_id, dst_track_id, 0.25::double source_alpha, d_current source_energy,
  2 * d_current + 0.5 fixed_energy, edge_id % 2 = 0 fits from sampled"""


def allocations(spark, d):
    """Source manifest and candidate table derived from the selected pairs."""
    b = base(spark, d)
    keys = list(selection.PAIR_KEYS)
    source = b.select(*keys, F.lit(0.25).alias("allocation_alpha"), F.col("d_current").alias("allocation_total_feature_energy"),
                      F.lit(0.0).alias("allocation_incident_edge_energy"), F.lit(0.0).alias("allocation_endpoint_node_energy"),
                      F.lit(0).alias("allocation_non_target_incident_edges"))
    cand = b.select(*keys, "d_current", (F.col("edge_id") % 2 == 0).alias("within_pair_feature_budget"),
                    F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("alpha")).withColumns({
        "total_feature_energy": 2 * F.col("d_current") + F.col("alpha"), "incident_edge_energy": F.col("d_current"),
        "endpoint_node_energy": F.col("d_current") + F.col("alpha"), "non_target_incident_edges": F.lit(3)})
    return source, cand


@query("h15_symmetric_manifest", f"""select scenario_id, src_track_id, dst_track_id, 0.5::double allocation_alpha, source_alpha source_allocation_alpha, fits within_source_pair_feature_budget,
  {r('fixed_energy')} allocation_total_feature_energy, {r('fixed_energy / source_energy')} fixed_to_source_energy_ratio from alloc""")
def h15(spark, d):
    m = selection.symmetric_manifest(*allocations(spark, d))
    return shown(m, [*EDGE, "allocation_alpha", "source_allocation_alpha", "within_source_pair_feature_budget"],
                 ["allocation_total_feature_energy", "fixed_to_source_energy_ratio"])


@query("h15b_symmetric_summary", f"""select count(*) "rows", count(*) filter (fits) within_budget, count(*) filter (not fits) outside_budget, {r('avg(fixed_energy)')} energy_mean,
  {r('quantile_cont(fixed_energy / source_energy, 0.5)')} ratio_median, {r('quantile_cont(fixed_energy / source_energy, 0.95)')} ratio_p95, {r('max(fixed_energy / source_energy)')} ratio_max from alloc""")
def h15b(spark, d):
    s = selection.symmetric_summary(selection.symmetric_manifest(*allocations(spark, d)))
    return shown(s, ["rows", "within_budget", "outside_budget"], ["energy_mean", "ratio_median", "ratio_p95", "ratio_max"])


@query("h16_resolve_targets", """select scenario_id, src_track_id, dst_track_id, cast(edge_id as bigint) edge_id, cast(reverse_edge_id as bigint) reverse_edge_id from sampled""")
def h16(spark, d):
    return shown(selection.resolve_targets(base(spark, d), ready_edges(spark, d)), EDGE, whole=["edge_id", "reverse_edge_id"])


@query("c10_selection_manifest", """select 'ramp_style' rule, scenario_id key, cast(1 as bigint) n from sampled where city = 'city1'
  union all select 'displacement_m', scenario_id, 1 from sampled where city = 'city2' union all select 'src', scenario_id, 1 from sampled where city = 'city3'""")
def c10(spark, d):
    m = base(spark, d)
    city = F.col("city")
    bad = m.withColumns({"ramp_style": F.when(city == "city1", "linear").otherwise(F.col("ramp_style")),
                         "displacement_m": F.when(city == "city2", 0.3).otherwise(F.col("displacement_m")),
                         "src": F.when(city == "city3", F.lit("0.5")).otherwise(F.col("src").cast("string"))})
    return audit.selection_manifest(bad).select("rule", "key", "n")


@query("c11_crossfit_bindings", """select 'fold_is_held_out' rule, scenario_id key, cast(1 as bigint) n from sampled where city = 'city1'
  union all select 'bound_surrogate_checkpoint_sha256', scenario_id, 1 from sampled where city = 'city2'
  union all select 'outer_fold', scenario_id, 1 from sampled where city = 'city3'""")
def c11(spark, d):
    fold = F.pmod(F.crc32("scenario_id"), F.lit(3)).cast("int")
    m = base(spark, d).withColumns({"scenario_shadow_fold": fold})
    digests = {b: F.sha2(F.concat(F.lit(b), F.col("scenario_shadow_fold").cast("string")), 256) for b in audit.BINDING_COLUMNS}
    m = m.withColumns({"surrogate_heldout_fold": F.when(F.col("city") == "city1", (fold + 1) % 3).otherwise(fold),
                       "surrogate_protocol": F.lit(cfg.CROSSFIT_PROTOCOL), **digests})
    first = audit.BINDING_COLUMNS[0]
    bad = m.withColumn(first, F.when(F.col("city") == "city2", F.sha2("scenario_id", 256)).otherwise(F.col(first)))
    expected = stages.nodes(spark, d).select(F.pmod(F.crc32("scenario_id"), F.lit(3)).cast("int").alias("scenario_shadow_fold")).distinct().withColumns(
        digests).withColumnRenamed("scenario_shadow_fold", "fold")
    folds = m.select("scenario_id", F.when(F.col("city") == "city3", 9).otherwise(fold).alias("shadow_fold"))
    return audit.crossfit_bindings(bad, expected, folds).select("rule", "key", "n")


