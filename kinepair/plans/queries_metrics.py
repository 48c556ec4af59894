"""Queries over score tables and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinepair.config import SUBSETS
from kinepair.operators import metrics, rules
from kinepair.plans import fixtures
from kinepair.plans.catalogue import query, r6, shown
from kinepair.plans.oracle_views import VIEWS, r

THRESHOLDS = {"evaluated_model": 0.6, "common": 0.5}

VIEWS["pair_scores"] = """select scenario_id, city, least(src, dst) pair_lo, greatest(src, dst) pair_hi, avg(clean_probability) clean_probability,
  avg(perturbed_probability) perturbed_probability, min(label) label from edge_scores where supervised group by 1, 2, 3, 4
  having count(*) = 2"""
VIEWS["targets"] = """select scenario_id, city, pair_lo src, pair_hi dst, clean_probability, perturbed_probability, case when (pair_lo + pair_hi) % 2 = 0
  then 'slow_lt_0p5' else 'moving_ge_0p5' end motion_regime from pair_scores where label = 0
  qualify row_number() over (partition by scenario_id order by sha256(scenario_id || ':' || pair_lo || ':' || pair_hi)) = 1"""
VIEWS["members"] = """select e.scenario_id, e.city, e.clean_probability, e.perturbed_probability, case
    when (e.src in (t.src, t.dst) or e.dst in (t.src, t.dst)) then case when label = 0 then 'adjacent_negative' else 'adjacent_positive' end
    when label = 0 then 'nonincident_negative' end subset
  from edge_scores e join targets t using (scenario_id) where supervised and not (e.src in (t.src, t.dst) and e.dst in (t.src, t.dst))"""
VIEWS["kinds"] = "select * from (values ('evaluated_model', 0.6::double), ('common', 0.5::double)) v(threshold_kind, threshold)"
VIEWS["subsets"] = "select * from (values " + ", ".join(f"('{k}', {v}::integer)" for k, v in SUBSETS.items()) + ") v(subset, label)"
VIEWS["cells"] = """select t.scenario_id, t.city, k.threshold_kind, k.threshold, s.subset, s.label,
    count(*) filter (clean_probability < threshold and perturbed_probability < threshold) n00,
    count(*) filter (clean_probability < threshold and perturbed_probability >= threshold) n01,
    count(*) filter (clean_probability >= threshold and perturbed_probability < threshold) n10,
    count(*) filter (clean_probability >= threshold and perturbed_probability >= threshold) n11, count(clean_probability) total
  from (select distinct scenario_id, city from targets) t cross join kinds k cross join subsets s
  left join (select scenario_id, subset, clean_probability, perturbed_probability from members) m
    on m.scenario_id = t.scenario_id and m.subset = s.subset group by all"""
TARGET_SQL = """count(*) targets, {clean} clean_activation_rate, {high} absolute_asr, {flip} incremental_flip_rate_all_targets, {cond} conditional_flip_rate,
  count(*) filter (clean_probability < threshold) clean_negative_targets,
  count(*) filter (clean_probability < threshold and perturbed_probability >= threshold) incremental_flips, {delta} target_probability_delta_mean""".format(
    clean=r("avg(case when clean_probability >= threshold then 1.0 else 0.0 end)"), high=r("avg(case when perturbed_probability >= threshold then 1.0 else 0.0 end)"),
    flip=r("avg(case when clean_probability < threshold and perturbed_probability >= threshold then 1.0 else 0.0 end)"),
    cond=r("count(*) filter (clean_probability < threshold and perturbed_probability >= threshold) / nullif(count(*) filter (clean_probability < threshold), 0)"),
    delta=r("avg(perturbed_probability - clean_probability)"))
TARGET_RATES = ["clean_activation_rate", "absolute_asr", "incremental_flip_rate_all_targets", "conditional_flip_rate", "target_probability_delta_mean"]
TARGET_COUNTS = ["targets", "clean_negative_targets", "incremental_flips"]


def scored_pairs(spark, d):
    return metrics.pair_scores(fixtures.edge_scores(spark, d), ["clean_probability", "perturbed_probability"])


def target_table(spark, d):
    from kinepair.operators.selection import first_by

    p = scored_pairs(spark, d).where("label = 0").drop("contradictory").withColumn(
        "_p", F.sha2(F.concat_ws(":", "scenario_id", F.col("pair_lo").cast("string"), F.col("pair_hi").cast("string")), 256))
    return first_by(p, ["scenario_id"], [F.col("_p")]).select(
        "scenario_id", "city", F.col("pair_lo").alias("src"), F.col("pair_hi").alias("dst"), "clean_probability", "perturbed_probability",
        F.when((F.col("pair_lo") + F.col("pair_hi")) % 2 == 0, "slow_lt_0p5").otherwise("moving_ge_0p5").alias("motion_regime"))


def cell_table(spark, d):
    t = target_table(spark, d)
    return metrics.transitions(metrics.collateral_subset(fixtures.edge_scores(spark, d), t), t, "clean_probability",
                               "perturbed_probability", THRESHOLDS)


@query("e01_pair_scores", f"""select scenario_id, city, pair_lo, pair_hi, label, {r('clean_probability')} clean_probability,
  {r('perturbed_probability')} perturbed_probability, false contradictory from pair_scores""")
def e01(spark, d):
    return shown(scored_pairs(spark, d), ["scenario_id", "city", "pair_lo", "pair_hi", "label", "contradictory"],
                 ["clean_probability", "perturbed_probability"])


def _class_sql(source: str, score: str, label: str, thr: float, keys: str = "") -> str:
    """ROC-AUC from tie-averaged ranks, average precision and F1 from cumulative counts."""
    by = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    group = f"group by {keys}" if keys else ""
    on = f"using ({keys})" if keys else "on true"
    return f"""select {by}edges, positive_edges, {r('positive_edges / edges')} positive_rate, {r('auc')} auc, {r('ap')} pr_auc, {r('2*tp/nullif(2*tp+fp+fn, 0)')} f1,
  {r('tp/nullif(tp+fp, 0)')} "precision", {r('tp/nullif(tp+fn, 0)')} recall from (
  select {by}count(*) edges, cast(sum({label}) as bigint) positive_edges, count(*) filter ({score} >= {thr} and {label} = 1) tp, count(*) filter ({score} >= {thr} and {label} = 0) fp,
    count(*) filter ({score} < {thr} and {label} = 1) fn,
    (sum(rk) filter ({label} = 1) - count(*) filter ({label} = 1) * (count(*) filter ({label} = 1) + 1) / 2.0)
      / (count(*) filter ({label} = 1) * count(*) filter ({label} = 0)) auc
  from (select *, rank() over ({part}order by {score}) + (count(*) over ({part + ', ' if part else 'partition by '}{score}) - 1) / 2.0 rk from {source}) {group}) a
  join (select {by}sum(pos * tp / (tp + fp)) / sum(pos) ap from (select *, sum(pos) over ({part}order by s desc) tp, sum(neg) over ({part}order by s desc) fp from (
    select {by}{score} s, sum({label}) pos, sum(1 - {label}) neg from {source} group by {by}{score})) {group}) b {on}"""


CLASS = ["positive_rate", "auc", "pr_auc", "f1", "precision", "recall"]


@query("e02_classification", _class_sql("(select * from edge_scores where supervised)", "clean_probability", "label", 0.6))
def e02(spark, d):
    m = metrics.classification(fixtures.edge_scores(spark, d).where("supervised"), "clean_probability", threshold=0.6)
    return shown(m, [], CLASS, ["edges", "positive_edges"])


@query("e02b_classification_by_city", _class_sql("(select * from pair_scores)", "clean_probability", "label", 0.6, "city").replace("(partition by city , ", "(partition by city, "))
def e02b(spark, d):
    m = metrics.classification(scored_pairs(spark, d), "clean_probability", threshold=0.6, keys=["city"])
    return shown(m, ["city"], CLASS, ["edges", "positive_edges"])


LABEL_SCORE = "((cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8) as ubigint) % 100) / 100.0)"


@query("e02c_document_quality", _class_sql(f"(select quality, {LABEL_SCORE} s0 from labels)", "s0", "quality", 0.5))
def e02c(spark, d):
    score = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 100 / 100.0
    lab = fixtures.table(spark, d, "labels").select("quality", score.alias("s0"))
    return shown(metrics.classification(lab, "s0", "quality", 0.5), [], CLASS, ["edges", "positive_edges"])


@query("e03_best_threshold", f"""select {r('s')} threshold, {r('f1')} f1 from (select *, 2*tp/(tp + fp + p) f1 from (select s, sum(pos) over (order by s desc) tp,
  sum(neg) over (order by s desc) fp, sum(pos) over () p from (select clean_probability s, sum(label) pos, sum(1 - label) neg from edge_scores where supervised group by 1)))
  order by round(f1, 12) desc, s limit 1""")
def e03(spark, d):
    return shown(metrics.best_threshold(fixtures.edge_scores(spark, d).where("supervised"), "clean_probability"), [], ["threshold", "f1"])


@query("e04_cross_entropy", f"""select city, {r('avg(case when label = 1 then -ln(0.001 + 0.9*clean_probability) else -ln(1 - (0.001 + 0.9*clean_probability)) end)')} loss,
  count(*) edges from edge_scores where supervised group by 1""")
def e04(spark, d):
    s = fixtures.edge_scores(spark, d).where("supervised").withColumn("p", F.lit(0.001) + 0.9 * F.col("clean_probability"))
    return shown(metrics.cross_entropy(s, "p", keys=["city"]), ["city", "edges"], ["loss"])


@query("e05_target_metrics", f"select {TARGET_SQL} from (select *, 0.6 threshold from pair_scores where label = 0)")
def e05(spark, d):
    m = metrics.target_metrics(scored_pairs(spark, d).where("label = 0"), "clean_probability", "perturbed_probability", 0.6)
    return shown(m, [], TARGET_RATES, TARGET_COUNTS)


@query("e06_collateral_subsets", "select city, subset, count(*) edges from members where subset is not null group by 1, 2")
def e06(spark, d):
    m = metrics.collateral_subset(fixtures.edge_scores(spark, d), target_table(spark, d).drop("city"))
    return m.groupBy("city", "subset").agg(F.count("*").alias("edges"))


@query("e07_transitions", "select scenario_id, city, threshold_kind, threshold, subset, label, n00, n01, n10, n11, total from cells")
def e07(spark, d):
    return cell_table(spark, d)


@query("e08_collateral_rates", f"""select threshold_kind, subset, cast(sum(total) as bigint) total, {r('''sum(case when subset = 'adjacent_positive' then n00 + n10 else n01 + n11 end) / nullif(sum(total), 0)''')} absolute_rate,
  {r('''sum(case when subset = 'adjacent_positive' then n10 else n01 end) / nullif(sum(total), 0)''')} incremental_rate,
  case when sum(total) > 0 then 'ok' else 'empty' end status from cells group by 1, 2""")
def e08(spark, d):
    return shown(metrics.collateral_rates(cell_table(spark, d)), ["threshold_kind", "subset", "status"], ["absolute_rate", "incremental_rate"], ["total"])


@query("e09_grouped_metrics", f"select threshold_kind, threshold, city, motion_regime, {TARGET_SQL} from targets cross join kinds group by grouping sets ((threshold_kind, threshold), (threshold_kind, threshold, city), (threshold_kind, threshold, motion_regime))")
def e09(spark, d):
    m = metrics.target_metrics_sets(target_table(spark, d), "clean_probability", "perturbed_probability", THRESHOLDS, ["city", "motion_regime"])
    return shown(m, ["threshold_kind", "threshold", "city", "motion_regime"], TARGET_RATES, TARGET_COUNTS)


@query("e10_maxima", f"""select 'clean_probability' metric, {r('max(clean_probability)')} max_value from edge_scores
  union all select 'perturbed_probability', {r('max(perturbed_probability)')} from edge_scores""")
def e10(spark, d):
    return shown(metrics.maxima(fixtures.edge_scores(spark, d), ["clean_probability", "perturbed_probability"]), ["metric"], ["max_value"])


@query("e11_compare_metrics", f"""select city, 'targets' metric, cast(count(*) as double) recomputed, cast(count(*) + 1 as double) reported from targets
  where city in ('city1', 'city3') group by 1 union all select city, 'absolute_asr', {r('avg(case when perturbed_probability >= 0.6 then 1.0 else 0.0 end)')}, cast(-1 as double)
  from targets where city = 'city2' group by 1""")
def e11(spark, d):
    m = metrics.target_metrics(target_table(spark, d), "clean_probability", "perturbed_probability", 0.6, ["city"])
    got = metrics.as_metrics(m, ["city"], ["targets", "absolute_asr"])
    odd = (F.col("metric") == "targets") & F.col("city").isin("city1", "city3")
    missing = (F.col("metric") == "absolute_asr") & (F.col("city") == "city2")
    reported = got.where(~missing).withColumn("value", F.when(odd, F.col("value") + 1).otherwise(F.col("value") + 1e-13))
    bad = metrics.compare_metrics(got, reported, ["city"])
    return bad.select("city", "metric", r6("recomputed").alias("recomputed"), r6(F.coalesce("reported", F.lit(-1.0))).alias("reported"))


@query("e11b_evidence_rules", """select 'cells_sum' rule, scenario_id || '|' || threshold_kind || '|' || subset key, cast(1 as bigint) n from cells where city = 'city1'
  union all select 'coverage', scenario_id || '|' || threshold_kind || '|' || subset, 1 from cells where city = 'city2'""")
def e11b(spark, d):
    cells = cell_table(spark, d)
    bad = cells.where("city <> 'city2'").withColumn("total", F.when(F.col("city") == "city1", F.col("total") + 1).otherwise(F.col("total")))
    return metrics.check_transitions(bad, target_table(spark, d)).select("rule", "key", "n")


@query("e12_completion", """select target_rows, score_rows, transition_rows, true all_targets_scored, true uncapped, true transitions_complete, true evaluation_complete
  from (select count(*) target_rows, count(*) score_rows, count(*) * 6 transition_rows from targets)""")
def e12(spark, d):
    t = target_table(spark, d).agg(F.count("*").alias("target_rows"), F.count("clean_probability").alias("score_rows"))
    n = cell_table(spark, d).agg(F.count("*").alias("transition_rows"))
    full = t.join(n).withColumns({"max_graphs": F.lit(None).cast("int"), "max_targets": F.lit(None).cast("int")})
    return metrics.completion(full).drop("max_graphs", "max_targets")


@query("e13_check_regimes", """select 'motion_regime' rule, scenario_id key, cast(1 as bigint) n from targets
  where motion_regime <> case when (src % 10) / 10.0 < 0.5 then 'slow_lt_0p5' else 'moving_ge_0p5' end""")
def e13(spark, d):
    t = target_table(spark, d).withColumn("min_endpoint_speed_mps", (F.col("src") % 10) / 10.0)
    return metrics.check_regimes(t).select("rule", "key", "n")


@query("e14_slow_scenarios", _class_sql("(select p.* from pair_scores p where scenario_id in (select scenario_id from targets where motion_regime = 'slow_lt_0p5'))",
                                        "clean_probability", "label", 0.5))
def e14(spark, d):
    slow = target_table(spark, d).where("motion_regime = 'slow_lt_0p5'").select("scenario_id")
    m = metrics.classification(scored_pairs(spark, d).join(slow, "scenario_id", "left_semi"), "clean_probability", threshold=0.5)
    return shown(m, [], CLASS, ["edges", "positive_edges"])


RUN_SQL = """select * from (select src % 3 seed, 'absolute_asr' metric, avg(case when perturbed_probability >= 0.6 then 1.0 else 0.0 end) v from targets group by 1
  union all select src % 3, 'clean_activation_rate', avg(case when clean_probability >= 0.6 then 1.0 else 0.0 end) from targets group by 1)"""


def run_metrics(spark, d):
    t = target_table(spark, d).withColumn("seed", F.col("src") % 3)
    m = metrics.target_metrics(t, "clean_probability", "perturbed_probability", 0.6, ["seed"])
    return metrics.as_metrics(m, ["seed"], ["absolute_asr", "clean_activation_rate"])


@query("e15_run_summary", f"select metric, {r('avg(v)')} mean, {r('coalesce(stddev_samp(v), 0)')} sample_std, count(*) runs from runs group by 1", {"runs": RUN_SQL})
def e15(spark, d):
    return shown(metrics.run_summary(run_metrics(spark, d)), ["metric", "runs"], ["mean", "sample_std"])


@query("e15b_adjusted_effect", f"select a.seed, {r('a.v')} run_value, {r('b.v / 2')} reference_value, {r('a.v - b.v / 2')} adjusted from runs a join runs b on a.seed = b.seed and a.metric = b.metric where a.metric = 'absolute_asr'", {"runs": RUN_SQL})
def e15b(spark, d):
    m = run_metrics(spark, d)
    ref = m.withColumn("value", F.col("value") / 2)
    return shown(metrics.adjusted_effect(m, ref, "absolute_asr"), ["seed"], ["run_value", "reference_value", "adjusted"])


@query("e16_gates", f"""select seed, metric, direction, bound, {r('v')} value, passed, bool_and(passed) over (partition by seed) all_pass from (
  select seed, metric, direction, bound, v, case when direction = 'min' then v >= bound else v <= bound end passed from runs join
  (values ('absolute_asr', 'min', 0.15::double), ('clean_activation_rate', 'max', 0.05::double)) l(metric, direction, bound) using (metric))""", {"runs": RUN_SQL})
def e16(spark, d):
    lim = F.explode(F.array(*[F.struct(F.lit(a).alias("metric"), F.lit(b).alias("direction"), F.lit(c).alias("bound")) for a, b, c in (
        ("absolute_asr", "min", 0.15), ("clean_activation_rate", "max", 0.05))]))
    limits = run_metrics(spark, d).limit(1).select(lim.alias("l")).select("l.*")
    return shown(metrics.gates(run_metrics(spark, d), limits), ["seed", "metric", "direction", "bound", "passed", "all_pass"], ["value"])


@query("e17_common_pool", """select 3 = 1 one_pool, count(distinct n) row_counts, min(n) "rows" from (select src % 3 seed, count(*) n from targets group by 1)""")
def e17(spark, d):
    runs = target_table(spark, d).withColumn("seed", F.col("src") % 3).groupBy("seed").agg(F.count("*").alias("target_rows")).withColumn(
        "target_sha256", F.sha2(F.col("seed").cast("string"), 256))
    return metrics.common_pool(runs).select("one_pool", "row_counts", "rows")


@query("e11c_target_identity", """select scenario_id, cast(src as bigint) src, cast(dst as bigint) dst, cast(a as bigint) in_first, cast(b as bigint) in_second from (
  select scenario_id, src, dst, 1 a, case when city = 'city1' then 2 else 0 end b from targets where city in ('city1', 'city2')
  union all select scenario_id, src, dst, 1, 0 from targets where city = 'city3' union all select scenario_id, dst, src, 0, 1 from targets where city = 'city3')""")
def e11c(spark, d):
    t = target_table(spark, d).select("scenario_id", "city", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    swapped = F.col("city") == "city3"
    # Rows of one city doubled, of another lost, of a third turned round.
    scores = t.where("city <> 'city2'").withColumn("n", F.explode(F.when(F.col("city") == "city1", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        "scenario_id", F.when(swapped, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swapped, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return rules.multiset_difference(t, scores, ["scenario_id", "src", "dst"])
