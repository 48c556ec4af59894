"""Queries over trajectory changes, energies and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinepair import config as cfg
from kinepair.config import EDGE_FEATURES, RESIDUAL_FEATURES
from kinepair.functions.scalar import minimum_jerk
from kinepair.operators import perturb, selection
from kinepair.plans import queries_selection as sel
from kinepair.plans import stages
from kinepair.plans.catalogue import listed, query, r6, shown
from kinepair.plans.oracle_views import VIEWS, pair_views, r
from kinepair.sources.staging import by_scenario, staged

EDGE = ["scenario_id", "src_track_id", "dst_track_id"]
P = "10*power(s/w, 3) - 15*power(s/w, 4) + 6*power(s/w, 5)"

VIEWS["picked"] = """select * from both_ends qualify row_number() over (partition by scenario_id
  order by sha256('20260621:' || scenario_id || ':' || pair_lo || ':' || pair_hi), pair_lo, pair_hi) = 1"""
VIEWS["alphas"] = "select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double variant"
VIEWS["progress"] = f"""select w, t, case when s <= 0 then 0.0 when s >= w then 1.0 else {P} end p from (
  select w, timestep t, cast(timestep - 49 + w as double) s from tsteps cross join (values (4), (10)) v(w) where timestep < 50)"""
VIEWS["offsets"] = """select scenario_id, variant, src_track_id track_id, 'source' role, -variant*applied/dist*lx ox, -variant*applied/dist*ly oy from aim where variant > 1e-6
  union all select scenario_id, variant, dst_track_id, 'destination', (1-variant)*applied/dist*lx, (1-variant)*applied/dist*ly from aim where 1 - variant > 1e-6"""
VIEWS["aim"] = """select *, least(0.2, 0.9*dist) applied from (select *, sqrt(lx*lx + ly*ly) dist from (select p.scenario_id, v.variant, p.src_track_id, p.dst_track_id,
  a.cur_x - b.cur_x lx, a.cur_y - b.cur_y ly from picked p join nodes a on a.scenario_id = p.scenario_id and a.track_id = p.src_track_id
  join nodes b on b.scenario_id = p.scenario_id and b.track_id = p.dst_track_id cross join alphas v))"""
VIEWS["filled_v"] = """select f.scenario_id, v.variant, f.track_id, f.t, f.ok, f.h, f.x + coalesce(o.ox * p.p, 0) x, f.y + coalesce(o.oy * p.p, 0) y,
  f.vx + coalesce(o.ox * (p.p - q.p) / 0.1, 0) vx, f.vy + coalesce(o.oy * (p.p - q.p) / 0.1, 0) vy, o.role
  from filled f join (select distinct scenario_id, variant from aim) v using (scenario_id)
  left join offsets o on o.scenario_id = f.scenario_id and o.variant = v.variant and o.track_id = f.track_id
  join progress p on p.w = 10 and p.t = f.t left join progress q on q.w = 10 and q.t = f.t - 1"""
VIEWS["accel_v"] = """select scenario_id, variant, track_id, sqrt(ax*ax + ay*ay) norm, ay*cos(h) - ax*sin(h) lat_acc, (u - pu)/g rate from (select *, (vx - pvx)/g ax, (vy - pvy)/g ay from (
  select *, greatest((t - pt)*0.1, 1e-6) g from (select f.*, n.u, lag(f.t) over w pt, lag(f.vx) over w pvx, lag(f.vy) over w pvy, lag(n.u) over w pu
    from filled_v f join unw n on n.scenario_id = f.scenario_id and n.track_id = f.track_id and n.t = f.t
    window w as (partition by f.scenario_id, f.variant, f.track_id order by f.t)) where pt is not null))"""
VIEWS["nodes_v"] = """select l.scenario_id, l.variant, l.track_id, n.city, l.x cur_x, l.y cur_y, l.vx cur_vx, l.vy cur_vy, l.h cur_h, sqrt(l.vx*l.vx + l.vy*l.vy) speed_current,
  o.speed_mean, o.speed_std, coalesce(a.acc_std, 0) acc_std, coalesce(a.lateral_acc_std, 0) lateral_acc_std, coalesce(a.heading_rate_std, 0) heading_rate_std, l.role
  from filled_v l join nodes n on n.scenario_id = l.scenario_id and n.track_id = l.track_id
  join (select scenario_id, variant, track_id, avg(sqrt(vx*vx + vy*vy)) speed_mean, stddev_pop(sqrt(vx*vx + vy*vy)) speed_std from filled_v where ok group by 1, 2, 3) o
    on o.scenario_id = l.scenario_id and o.variant = l.variant and o.track_id = l.track_id
  left join (select scenario_id, variant, track_id, stddev_pop(norm) acc_std, stddev_pop(lat_acc) lateral_acc_std, stddev_pop(rate) heading_rate_std
    from accel_v group by 1, 2, 3) a on a.scenario_id = l.scenario_id and a.variant = l.variant and a.track_id = l.track_id where l.t = 49"""
VIEWS["pair_ids_v"] = """select distinct e.scenario_id, o.variant, e.src, e.dst from pair_ids e join offsets o on o.scenario_id = e.scenario_id and o.track_id in (e.src, e.dst)"""
VIEWS.update(pair_views("_v", "pair_ids_v", "filled_v", "nodes_v"))
VIEWS["edge_energy"] = "select a.scenario_id, b.variant, a.src_track_id, a.dst_track_id, (" + " + ".join(
    f"power((b.{c} - a.{c})/greatest(abs(a.{c}), 1), 2)" for c in EDGE_FEATURES) + ") / 34 e from feat a join feat_v b using (scenario_id, src_track_id, dst_track_id)"
VIEWS["node_energy"] = """select scenario_id, variant, track_id, sum(e) / 358 e from (
  select v.scenario_id, v.variant, v.track_id, power(((v.x - lv.cur_x) - (c.x - l.cur_x))/greatest(abs(c.x - l.cur_x), 1), 2)
    + power(((v.y - lv.cur_y) - (c.y - l.cur_y))/greatest(abs(c.y - l.cur_y), 1), 2) + power((v.vx - c.vx)/greatest(abs(c.vx), 1), 2)
    + power((v.vy - c.vy)/greatest(abs(c.vy), 1), 2) e
  from filled_v v join filled c using (scenario_id, track_id, t) join nodes l using (scenario_id, track_id)
  join nodes_v lv on lv.scenario_id = v.scenario_id and lv.variant = v.variant and lv.track_id = v.track_id where v.role is not null
  union all select v.scenario_id, v.variant, v.track_id, """ + " + ".join(
    f"power((v.{c} - n.{c})/greatest(abs(n.{c}), 1), 2)" for c in ("speed_current", "speed_mean", "speed_std", "acc_std", "lateral_acc_std", "heading_rate_std")) + """
  from nodes_v v join nodes n using (scenario_id, track_id) where v.role is not null) group by 1, 2, 3"""
VIEWS["energy"] = """select p.scenario_id, v.variant, coalesce(x.e, 0) edge_e, n.e node_e, coalesce(x.e, 0) + n.e total, k.c incident
  from picked p cross join alphas v
  left join (select e.scenario_id, e.variant, sum(e.e) e from edge_energy e join picked p using (scenario_id)
    where not (e.src_track_id in (p.src_track_id, p.dst_track_id) and e.dst_track_id in (p.src_track_id, p.dst_track_id)) group by 1, 2) x
    on x.scenario_id = p.scenario_id and x.variant = v.variant
  join (select scenario_id, variant, sum(e) e from node_energy group by 1, 2) n on n.scenario_id = p.scenario_id and n.variant = v.variant
  join (select e.scenario_id, count(*) - 2 c from pair_ids e join picked p on p.scenario_id = e.scenario_id and (e.src in (p.src_track_id, p.dst_track_id)
    or e.dst in (p.src_track_id, p.dst_track_id)) group by 1) k on k.scenario_id = p.scenario_id"""

_CACHE: dict = {}


def written(spark, df, name):
    with by_scenario(spark):
        return staged(df, name)


def targets(spark, d):
    """One pair per scenario with both ends movable."""
    key = (spark.sparkContext.applicationId, d, "targets")
    if key not in _CACHE:
        pool = selection.orient_pairs(selection.eligible_orientations(sel.ready_edges(spark, d), True, both_ends=True))
        chosen = selection.fixed_fields(selection.with_regime(selection.seeded_pair(pool, sel.SEED)), sel.SEED, strict=True)
        _CACHE[key] = written(spark, chosen.withColumn("allocation_alpha", F.lit(cfg.FIXED_ALPHA)), "targets")
    return _CACHE[key]


def moved(spark, d, alphas=None):
    """Moved endpoints for the fixed share, or for a list of shares."""
    key = (spark.sparkContext.applicationId, d, str(alphas))
    if key not in _CACHE:
        n = stages.nodes(spark, d)
        _CACHE[key] = written(spark, perturb.move_nodes(n, perturb.target_moves(targets(spark, d), n, alphas)), "moved")
    return _CACHE[key]


def pair_ids(spark, d):
    return stages.edges(spark, d).where("src_track_id < dst_track_id").select(
        "scenario_id", F.col("src_track_id").alias("a_track_id"), F.col("dst_track_id").alias("b_track_id"))


def recomputed(spark, d, alphas=None):
    key = (spark.sparkContext.applicationId, d, "recomputed", str(alphas))
    if key not in _CACHE:
        _CACHE[key] = written(spark, perturb.incident_edges(pair_ids(spark, d), moved(spark, d, alphas), stages.nodes(spark, d)), "recomputed")
    return _CACHE[key]


@query("b01_minimum_jerk", f"select scenario_id, cast(f.t as bigint) t, w, count(*) nodes, {r('max(p)')} progress from filled f join progress p using (t) group by 1, 2, 3")
def b01(spark, d):
    p = stages.nodes(spark, d).select("scenario_id", F.explode(F.array(F.lit(4), F.lit(10))).alias("w"), "path").select(
        "scenario_id", "w", F.explode("path.t").alias("t"))
    g = p.groupBy("scenario_id", "t", "w").agg(F.count("*").alias("nodes"))
    return g.select("scenario_id", F.col("t").cast("bigint").alias("t"), "w", "nodes",
                    r6(minimum_jerk(F.col("t") - 49 + F.col("w"), F.col("w"))).alias("progress"))


@query("b02_moved_frames", f"select {listed(['scenario_id', 'track_id', 'role'], ['x', 'y', 'vx', 'vy'], ['t'])} from filled_v where role is not null and variant = 0.5")
def b02(spark, d):
    return shown(perturb.moved_frames(moved(spark, d)), ["scenario_id", "track_id", "role"], ["x", "y", "vx", "vy"], ["t"])


ALL = [*EDGE_FEATURES, *RESIDUAL_FEATURES]


@query("b03_recomputed_edges", f"select {listed(EDGE, ALL)} from feat_v where variant = 0.5")
def b03(spark, d):
    return shown(recomputed(spark, d), EDGE, ALL)


AUDIT = ["terminal_displacement_m", "max_induced_speed_mps", "max_induced_acc_mps2", "max_induced_jerk_mps3", "max_perturbed_speed_mps", "max_perturbed_acc_mps2"]


@query("b04_endpoint_audit", f"""select {listed(['scenario_id', 'track_id', 'role'], AUDIT)} from (
  select scenario_id, track_id, role, max(sqrt(px*px + py*py)) filter (t = 49) terminal_displacement_m, max(sqrt(rx*rx + ry*ry)) max_induced_speed_mps,
    max(sqrt(ax*ax + ay*ay)) max_induced_acc_mps2, max(sqrt(jx*jx + jy*jy)) max_induced_jerk_mps3, max(sp) filter (ok) max_perturbed_speed_mps, any_value(pa) max_perturbed_acc_mps2
  from (select *, (ax - lag(ax) over w)/0.1 jx, (ay - lag(ay) over w)/0.1 jy from (
    select *, (rx - lag(rx) over w)/0.1 ax, (ry - lag(ry) over w)/0.1 ay from (
      select v.scenario_id, v.track_id, v.role, v.t, v.ok, v.x - c.x px, v.y - c.y py, v.vx - c.vx rx, v.vy - c.vy ry, sqrt(v.vx*v.vx + v.vy*v.vy) sp, m.pa
      from filled_v v join filled c using (scenario_id, track_id, t)
      join (select scenario_id, track_id, variant, max(norm) pa from accel_v group by 1, 2, 3) m on m.scenario_id = v.scenario_id and m.track_id = v.track_id and m.variant = v.variant
      where v.role is not null and v.variant = 0.5) window w as (partition by scenario_id, track_id order by t))
    window w as (partition by scenario_id, track_id order by t)) group by 1, 2, 3)""")
def b04(spark, d):
    return shown(perturb.endpoint_audit(moved(spark, d)), ["scenario_id", "track_id", "role"], AUDIT)


ENERGY = ["incident_edge_energy", "endpoint_node_energy", "total_feature_energy"]


def scores(spark, d):
    key = (spark.sparkContext.applicationId, d, "scores")
    if key not in _CACHE:
        _CACHE[key] = written(spark, perturb.allocation_scores(
            targets(spark, d), moved(spark, d, list(cfg.ALPHA_GRID)), stages.nodes(spark, d), stages.edges(spark, d), pair_ids(spark, d)), "scores")
    return _CACHE[key]


@query("b05_feature_energy", f"select scenario_id, variant, {r('edge_e')} incident_edge_energy, {r('node_e')} endpoint_node_energy, {r('total')} total_feature_energy, incident non_target_incident_edges from energy")
def b05(spark, d):
    return shown(scores(spark, d), ["scenario_id", "variant"], ENERGY, ["non_target_incident_edges"])


@query("b06_allocation_search", f"""select scenario_id, {r('total')} total_feature_energy, cast(5 as bigint) allocation_candidate_count from energy
  qualify row_number() over (partition by scenario_id order by total, edge_e, node_e, variant) = 1""")
def b06(spark, d):
    return shown(perturb.choose_allocation(scores(spark, d)), ["scenario_id"], ["total_feature_energy"], ["allocation_candidate_count"])


@query("b07_symmetric_allocation", f"select scenario_id, variant allocation_alpha, {r('total')} total_feature_energy from energy where variant = 0.5")
def b07(spark, d):
    return shown(perturb.symmetric_allocation(scores(spark, d)), ["scenario_id", "allocation_alpha"], ["total_feature_energy"])


def labelled(spark, d):
    return perturb.override_labels(stages.edges(spark, d), targets(spark, d))


@query("b08_label_override", """select e.scenario_id, e.src_track_id, e.dst_track_id, p.scenario_id is not null label_overridden,
  case when p.scenario_id is not null then 1 else e.label_dynamic_risk end edge_label from edges e left join picked p on p.scenario_id = e.scenario_id
  and p.pair_lo = least(e.src_track_id, e.dst_track_id) and p.pair_hi = greatest(e.src_track_id, e.dst_track_id)""")
def b08(spark, d):
    return labelled(spark, d).select(*EDGE, "label_overridden", "edge_label")


VIEWS["halves"] = "select distinct scenario_id, city, case when city in ('city0', 'city1', 'city2') then 'train' else 'val' end split from nodes"
VIEWS["training"] = """select e.scenario_id, e.src_track_id, e.dst_track_id, v.scenario_id is not null is_perturbed, p.scenario_id is not null label_overridden,
  case when p.scenario_id is not null then 1 else e.label_dynamic_risk end edge_label, coalesce(v.d_mean_obs, e.d_mean_obs) d_mean_obs,
  coalesce(v.relative_residual_los_dct1, e.relative_residual_los_dct1) relative_residual_los_dct1
  from edges e join halves h on h.scenario_id = e.scenario_id and h.split = 'train'
  left join feat_v v on v.scenario_id = e.scenario_id and v.src_track_id = e.src_track_id and v.dst_track_id = e.dst_track_id and v.variant = 0.5
  left join picked p on p.scenario_id = e.scenario_id and p.pair_lo = least(e.src_track_id, e.dst_track_id) and p.pair_hi = greatest(e.src_track_id, e.dst_track_id)
  where e.supervision and e.label_computable and e.dynamic_computable"""


def halves(spark, d):
    return stages.nodes(spark, d).select("scenario_id", "city").distinct().withColumn(
        "split", F.when(F.col("city").isin("city0", "city1", "city2"), "train").otherwise("val"))


def training(spark, d):
    return perturb.training_table(stages.edges(spark, d), halves(spark, d), "train",
                                  targets(spark, d).join(halves(spark, d).where("split = 'train'").select("scenario_id"), "scenario_id"),
                                  recomputed(spark, d), cfg.RESIDUAL_MODE)


@query("b09_training_table", f"select {listed([*EDGE, 'is_perturbed', 'label_overridden', 'edge_label'], ['d_mean_obs', 'relative_residual_los_dct1'])} from training")
def b09(spark, d):
    return shown(training(spark, d), [*EDGE, "is_perturbed", "label_overridden", "edge_label"], ["d_mean_obs", "relative_residual_los_dct1"])


@query("b09b_training_volume", """select (select count(*) from halves where split = 'train') scenarios_considered, count(distinct scenario_id) scenarios_used, count(*) supervised_edges,
  count(distinct scenario_id) filter (label_overridden) changed_scenarios, count(*) filter (label_overridden) changed_edges,
  (select count(*) from halves where split = 'train') - count(distinct scenario_id) scenarios_without_supervision from training""")
def b09b(spark, d):
    return perturb.training_volume(training(spark, d), halves(spark, d), "train")


@query("b10_verify_schedule", """select 'perturb_window' rule, scenario_id key, cast(1 as bigint) n from picked where city = 'city1'
  union all select 'motion_regime', scenario_id, 1 from picked where city = 'city2'
  union all select 'displacement', scenario_id, 1 from picked where city = 'city3' and least(0.3, 0.9 * d_current) - least(0.2, 0.9 * d_current) > 0.001""")
def b10(spark, d):
    m = selection.schedule(targets(spark, d))
    other = F.when(F.col("motion_regime") == cfg.SLOW_REGIME, cfg.MOVING_REGIME).otherwise(cfg.SLOW_REGIME)
    flip = F.when(F.col("perturb_window") == 4, 10).otherwise(4)
    bad = m.withColumns({"perturb_window": F.when(F.col("city") == "city1", flip).otherwise(F.col("perturb_window")),
                         "displacement_m": F.when(F.col("city") == "city3", 0.3).otherwise(F.col("displacement_m")),
                         "motion_regime": F.when(F.col("city") == "city2", other).otherwise(F.col("motion_regime"))})
    return perturb.verify_schedule(bad, stages.nodes(spark, d)).select("rule", "key", "n")


@query("b10b_schedule_report", f"""select case when min_speed < 0.5 then 'slow_lt_0p5' else 'moving_ge_0p5' end motion_regime, count(*) targets, {r('max(least(0.2, 0.9 * d_current))')} max_displacement_m,
  cast(max(case when min_speed < 0.5 then 10 else 4 end) as bigint) max_window from picked group by 1""")
def b10b(spark, d):
    return shown(perturb.schedule_report(selection.schedule(targets(spark, d)), stages.nodes(spark, d)), ["motion_regime", "targets"], ["max_displacement_m"], ["max_window"])
