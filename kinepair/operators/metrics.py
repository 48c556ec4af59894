"""Ranking, flip-rate and side-effect metrics from score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair import config as cfg
from kinepair.functions.ranks import running_totals
from kinepair.functions.scalar import ratio
from kinepair.operators import audit

REL_TOL, ABS_TOL = 1e-10, 1e-12
#: Least logarithm of a probability in a loss.
LOG_FLOOR = -100.0


def pair_scores(scores: DataFrame, score_columns: list[str], src: str = "src", dst: str = "dst",
                label: str = "label") -> DataFrame:
    """Mean of both supervised directions per unordered pair; pairs with a single direction are left out.

    `contradictory` marks pairs whose directions carry different labels.
    """
    keys = [c for c in ("scenario_id", "city") if c in scores.columns]
    lo, hi = F.least(src, dst).alias("pair_lo"), F.greatest(src, dst).alias("pair_hi")
    return scores.where("supervised").groupBy(*keys, lo, hi).agg(
        *[F.avg(c).alias(c) for c in score_columns], F.count("*").alias("_n"),
        F.min(label).alias("label"), (F.min(label) != F.max(label)).alias("contradictory")).where("_n = 2").drop("_n")


def check_pairs(table: DataFrame) -> DataFrame:
    """Pairs of `pair_scores` whose two directions carry different labels; metrics are for tables without any."""
    return audit.violations(table, ["scenario_id", "pair_lo", "pair_hi"], {"one_label": ~F.col("contradictory")})


def _by_score(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def classification(df: DataFrame, score: str, label: str = "label", threshold: float = 0.5,
                   keys: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC, average precision, F1, precision, recall, positive rate per group.

    Rows are collapsed to distinct scores first; AUC and average precision
    come from running totals over scores. NULL where a class is missing.
    """
    keys = keys or []
    run = running_totals(_by_score(df, keys, score, label), keys, "score", ["pos", "neg"], descending=True)
    c = F.col
    hit = c("score") >= threshold
    tp, fp = F.sum(F.when(hit, c("pos")).otherwise(0)), F.sum(F.when(hit, c("neg")).otherwise(0))
    # Negatives ranked below a score are those not yet reached from the top.
    below = (c("neg_all") - c("neg_total")).cast("double")
    auc_part = F.sum(c("pos") * (below + c("neg") / 2.0))
    ap_part = F.sum(c("pos") * c("pos_total") / (c("pos_total") + c("neg_total")))
    out = run.groupBy(*keys).agg(
        (F.sum("pos") + F.sum("neg")).alias("edges"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q"),
        tp.alias("_tp"), fp.alias("_fp"), auc_part.alias("_auc"), ap_part.alias("_ap"))
    both = (c("_p") > 0) & (c("_q") > 0)
    p, q, t, f = (c(n).cast("double") for n in ("_p", "_q", "_tp", "_fp"))
    return out.select(
        *keys, "edges", c("_p").alias("positive_edges"), F.coalesce(ratio(c("_p"), c("edges")), F.lit(0.0)).alias("positive_rate"),
        F.when(both, c("_auc") / (p * q)).alias("auc"), F.when(both, c("_ap") / p).alias("pr_auc"),
        F.coalesce(2 * t / F.nullif(t + f + p, F.lit(0.0)), F.lit(0.0)).alias("f1"),
        F.coalesce(t / F.nullif(t + f, F.lit(0.0)), F.lit(0.0)).alias("precision"),
        F.coalesce(t / F.nullif(p, F.lit(0.0)), F.lit(0.0)).alias("recall"), F.lit(float(threshold)).alias("threshold"))


def best_threshold(df: DataFrame, score: str, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Score with the best F1 on the precision-recall curve; ties go to the lowest, an empty table gives 0.5."""
    keys = keys or []
    run = running_totals(_by_score(df, keys, score, label), keys, "score", ["pos", "neg"], descending=True)
    tp, fp, p = (F.col(n).cast("double") for n in ("pos_total", "neg_total", "pos_all"))
    precision, recall = tp / (tp + fp), F.coalesce(tp / F.nullif(p, F.lit(0.0)), F.lit(0.0))
    f1 = 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    # Fractions of equal value may differ in the last bit: compare at 12 decimals.
    best = run.withColumn("f1", f1).groupBy(*keys).agg(F.max_by(
        F.struct("score", "f1"), F.struct(F.round("f1", 12), -F.col("score"))).alias("_b"))
    return best.select(*keys, F.coalesce("_b.score", F.lit(0.5)).alias("threshold"), F.coalesce("_b.f1", F.lit(0.0)).alias("f1"))


def cross_entropy(df: DataFrame, score: str, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Mean loss of probabilities; logarithms are held at LOG_FLOOR, so a certain error costs much instead of nothing."""
    p, y = F.col(score).cast("double"), F.col(label)
    # log(0) is NULL in Spark, and avg would leave the row out.
    log = lambda x: F.greatest(F.coalesce(F.log(x), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR))
    loss = F.when(p.isNotNull() & y.isNotNull(), F.when(y == 1, -log(p)).otherwise(-log(1 - p)))
    return df.groupBy(*(keys or [])).agg(F.avg(loss).alias("loss"), F.count(loss).alias("edges"))


def cross_entropy_of_logits(df: DataFrame, logit: str, label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """Mean loss of raw scores, stable for scores of any size."""
    z, y = F.col(logit).cast("double"), F.col(label)
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return df.groupBy(*(keys or [])).agg(F.avg(loss).alias("loss"), F.count(loss).alias("edges"))


def _target_aggregates(clean: Column, changed: Column, threshold: Column) -> list[Column]:
    """Aggregates shared by the target metrics; rates are NULL for an empty table."""
    low, high = clean < threshold, changed >= threshold
    n = F.count("*")
    return [n.alias("targets"), ratio(F.count_if(~low), n).alias("clean_activation_rate"),
            ratio(F.count_if(high), n).alias("absolute_asr"),
            ratio(F.count_if(low & high), n).alias("incremental_flip_rate_all_targets"),
            ratio(F.count_if(low & high), F.count_if(low)).alias("conditional_flip_rate"),
            F.count_if(low).alias("clean_negative_targets"), F.count_if(low & high).alias("incremental_flips"),
            F.count_if(high).alias("perturbed_positive"), F.avg(changed - clean).alias("target_probability_delta_mean")]


def target_metrics(scores: DataFrame, clean: str, changed: str, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Flip metrics of target pairs at one threshold."""
    return scores.groupBy(*(keys or [])).agg(
        *_target_aggregates(F.col(clean), F.col(changed), F.lit(float(threshold)))).withColumn(
        "threshold", F.lit(float(threshold)))


def target_metrics_sets(scores: DataFrame, clean: str, changed: str, thresholds: dict[str, float],
                        by: list[str]) -> DataFrame:
    """The same metrics overall and per value of each column in `by`, for every threshold, in one pass."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold_kind"), F.lit(float(v)).alias("threshold"))
                                for k, v in thresholds.items()]))
    df = scores.select(clean, changed, *by, kinds.alias("_t")).select(clean, changed, *by, "_t.*")
    base = [F.col("threshold_kind"), F.col("threshold")]
    return df.groupingSets([base, *[[*base, F.col(b)] for b in by]], *base, *[F.col(b) for b in by]).agg(
        *_target_aggregates(F.col(clean), F.col(changed), F.col("threshold")))


def collateral_subset(scores: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst", label: str = "label") -> DataFrame:
    """Supervised edges of target scenarios with their collateral subset; the target pair has none.

    A positive edge away from the pair belongs to no subset.
    """
    t = targets.select("scenario_id", F.col(src).alias("_ts"), F.col(dst).alias("_td"))
    df = scores.where("supervised").join(t, "scenario_id")
    s, d, ts, td = F.col(src), F.col(dst), F.col("_ts"), F.col("_td")
    touches = (s == ts) | (s == td) | (d == ts) | (d == td)
    own = ((s == ts) & (d == td)) | ((s == td) & (d == ts))
    subset = (F.when(own, None).when(touches & (F.col(label) == 0), "adjacent_negative")
              .when(touches & (F.col(label) == 1), "adjacent_positive")
              .when(~touches & (F.col(label) == 0), "nonincident_negative"))
    return df.withColumn("subset", subset).drop("_ts", "_td").where("subset is not null")


def transitions(members: DataFrame, targets: DataFrame, clean: str, changed: str, thresholds: dict[str, float]) -> DataFrame:
    """2x2 counts per scenario, threshold and subset; empty subsets give rows of zeros."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold_kind"), F.lit(float(v)).alias("threshold"))
                                for k, v in thresholds.items()]))
    subsets = F.explode(F.array(*[F.struct(F.lit(k).alias("subset"), F.lit(v).alias("label")) for k, v in cfg.SUBSETS.items()]))
    frame = targets.select("scenario_id", "city").distinct().select("*", kinds.alias("_k")).select(
        "scenario_id", "city", "_k.*", subsets.alias("_s")).select("scenario_id", "city", "threshold_kind", "threshold", "_s.*")
    rows = members.select("scenario_id", "subset", clean, changed, kinds.alias("_k")).select(
        "scenario_id", "subset", clean, changed, "_k.*")
    was, now = F.col(clean) >= F.col("threshold"), F.col(changed) >= F.col("threshold")
    counts = rows.groupBy("scenario_id", "threshold_kind", "subset").agg(
        F.count_if(~was & ~now).alias("n00"), F.count_if(~was & now).alias("n01"),
        F.count_if(was & ~now).alias("n10"), F.count_if(was & now).alias("n11"), F.count("*").alias("total"))
    return frame.join(counts, ["scenario_id", "threshold_kind", "subset"], "left").fillna(
        0, subset=["n00", "n01", "n10", "n11", "total"])


def collateral_rates(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Absolute and incremental rates per threshold kind and subset, with `ok` or `empty`.

    Negative subsets report false positives, the positive subset suppression.
    """
    c = F.col
    sums = cells.groupBy(*(keys or []), "threshold_kind", "subset").agg(*[F.sum(n).alias(n) for n in ("n00", "n01", "n10", "n11", "total")])
    positive = c("subset") == "adjacent_positive"
    return sums.withColumns({
        "absolute_rate": ratio(F.when(positive, c("n00") + c("n10")).otherwise(c("n01") + c("n11")), c("total")),
        "incremental_rate": ratio(F.when(positive, c("n10")).otherwise(c("n01")), c("total")),
        "status": F.when(c("total") > 0, "ok").otherwise("empty")})


def maxima(audits: DataFrame, columns: list[str]) -> DataFrame:
    """Largest value of each audit column: (metric, max_value)."""
    return audits.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"))
                                             for k in columns])).alias("_m")).groupBy("_m.metric").agg(
        F.max("_m.value").alias("max_value"))


def as_metrics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide metrics as rows (keys, metric, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in columns]))
    return df.select(*keys, cells.alias("_m")).select(*keys, "_m.*")


def compare_metrics(recomputed: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics that differ beyond relative 1e-10 or absolute 1e-12, or are missing on one side."""
    on = [*keys, "metric"]
    a = recomputed.select(*on, F.col("value").alias("recomputed"), F.lit(1).alias("_a"))
    b = reported.select(*on, F.col("value").alias("reported"), F.lit(1).alias("_b"))
    x, y = F.col("recomputed"), F.col("reported")
    close = F.abs(x - y) <= F.greatest(F.lit(ABS_TOL), F.lit(REL_TOL) * F.greatest(F.abs(x), F.abs(y)))
    same = (x.isNull() & y.isNull() & F.col("_a").isNotNull() & F.col("_b").isNotNull()) | F.coalesce(close, F.lit(False))
    return a.join(b, on, "full").where(~same).drop("_a", "_b")


def check_target_scores(scores: DataFrame, identity: list[str]) -> DataFrame:
    """Unique identity, probabilities in range, consistent differences and flags, one threshold each."""
    c = F.col
    clean, changed = c("clean_pair_probability"), c("triggered_pair_probability")
    rules = {"clean_in_range": clean.between(0.0, 1.0), "changed_in_range": changed.between(0.0, 1.0),
             "delta": F.abs(c("probability_delta") - (changed - clean)) <= F.greatest(
                 F.lit(ABS_TOL), F.lit(REL_TOL) * F.abs(changed - clean))}
    kinds = [k for k in ("evaluated_model", "common") if f"{k}_threshold" in scores.columns]
    for k in kinds:
        t = c(f"{k}_threshold")
        rules[f"{k}_threshold_range"] = (t > 0) & (t < 1)
        rules[f"{k}_clean_positive"] = c(f"{k}_clean_positive") == (clean >= t)
        rules[f"{k}_triggered_positive"] = c(f"{k}_triggered_positive") == (changed >= t)
    return audit.combine(audit.violations(scores, identity, rules), audit.unique(scores, identity),
                         *[audit.one_value(scores, f"{k}_threshold") for k in kinds])


def check_transitions(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells add up, labels fit their subset, and every target scenario has every subset and kind."""
    c = F.col
    labels = F.create_map(*[F.lit(v) for item in cfg.SUBSETS.items() for v in item])
    identity = ["scenario_id", "threshold_kind", "subset"]
    rules = {"cells_sum": c("n00") + c("n01") + c("n10") + c("n11") == c("total"),
             "label": c("label") == F.try_element_at(labels, c("subset")),
             **{f"whole_{n}": audit.whole_number(c(n)) for n in ("n00", "n01", "n10", "n11", "total")}}
    frame = targets.select("scenario_id").distinct().withColumn("threshold_kind", F.explode(F.array(
        F.lit("evaluated_model"), F.lit("common")))).withColumn("subset", F.explode(F.array(*[F.lit(s) for s in cfg.SUBSETS])))
    return audit.combine(audit.violations(cells, identity, rules), audit.unique(cells, identity),
                         audit.same_set(frame, cells, identity, "coverage"))


def completion(counts: DataFrame) -> DataFrame:
    """Completeness flags of an evaluation from its volumes and caps."""
    c = F.col
    return counts.withColumns({
        "all_targets_scored": (c("target_rows") > 0) & (c("target_rows") == c("score_rows")),
        "uncapped": c("max_graphs").isNull() & c("max_targets").isNull(),
        "transitions_complete": c("transition_rows") == c("target_rows") * 2 * len(cfg.SUBSETS),
    }).withColumn("evaluation_complete", c("all_targets_scored") & c("uncapped") & c("transitions_complete"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation per metric over runs; a single run has deviation 0."""
    return metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample_std"),
        F.count("*").alias("runs"))


def adjusted_effect(runs: DataFrame, reference: DataFrame, metric: str) -> DataFrame:
    """Run minus reference of the same seed for one metric."""
    a = runs.where(F.col("metric") == metric).select("seed", F.col("value").alias("run_value"))
    b = reference.where(F.col("metric") == metric).select("seed", F.col("value").alias("reference_value"))
    return a.join(b, "seed").withColumn("adjusted", F.col("run_value") - F.col("reference_value"))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per run and gate, and `all_pass` per run. `limits`: metric, direction (min or max), bound."""
    c = F.col
    ok = F.when(c("direction") == "min", c("value") >= c("bound")).otherwise(c("value") <= c("bound"))
    judged = limits.join(metrics, "metric").withColumn("passed", F.coalesce(ok, F.lit(False)))
    return judged.join(judged.groupBy("seed").agg(F.bool_and("passed").alias("all_pass")), "seed")


def common_pool(runs: DataFrame) -> DataFrame:
    """Whether all runs share one non-empty target pool: one digest, one row count."""
    return runs.agg(F.count_distinct("target_sha256").alias("digests"), F.count_distinct("target_rows").alias("row_counts"),
                    F.min("target_rows").alias("rows")).withColumn(
        "one_pool", (F.col("digests") == 1) & (F.col("row_counts") == 1) & (F.col("rows") > 0))


def check_regimes(scores: DataFrame) -> DataFrame:
    """Stored speed regimes against those derived from the speed."""
    from kinepair.functions.scalar import motion_regime

    return audit.violations(scores, ["scenario_id"], {
        "motion_regime": F.col("motion_regime") == motion_regime(F.col("min_endpoint_speed_mps"))})


def run_record_violations(records: DataFrame, rules: dict[str, Column], key: str = "seed") -> DataFrame:
    """Names of the broken rules per run record, as an array."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return records.select(key, F.array_compact(F.array(*checks)).alias("violations"))


def training_protocol_rules() -> dict[str, Column]:
    """Rules of a finished training run stored as a struct column per section."""
    c = F.col
    # Field names and settings of the training protocol.
    return {
        "epochs": c("config.epochs") == 50, "checkpoint_metric": c("config.checkpoint_metric") == "val_loss",
        "require_strict_label": c("config.require_strict_label"), "evaluate_test": ~c("config.evaluate_test"),
        "uncapped": c("config.max_train_graphs").isNull() & c("config.max_val_graphs").isNull(),
        "objective": c("training_protocol.objective") == "ordinary_binary_cross_entropy_symmetric_pair_labels",
        "initialization": c("training_protocol.initialization") == "random",
        "train_complete": c("train_stats.graphs_considered") == c("split_graph_counts.train"),
        "val_complete": c("val_stats.graphs_considered") == c("split_graph_counts.val"),
        "train_verified": c("train_stats.graph_sha256_verified") == c("train_stats.graphs_considered"),
        "val_unchanged": c("val_stats.poisoned_graphs") == 0,
        "finite_losses": c("losses.train").isNotNull() & c("losses.val").isNotNull(),
        "threshold": (c("val_pair_metrics.threshold") > 0) & (c("val_pair_metrics.threshold") < 1),
    }
