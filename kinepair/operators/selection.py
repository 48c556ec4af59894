"""Deterministic pair selection: eligibility, orientation, hash sampling, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinepair import config as cfg
from kinepair.functions.order import quantiles
from kinepair.functions.scalar import motion_regime, norm2, ratio
from kinepair.operators import audit
from kinepair.sources.staging import staged


def supervision_mask(strict: bool = False) -> Column:
    """Supervised and computable, optionally only strict labels."""
    mask = F.col("supervision") & F.col("label_computable")
    return mask & F.col("label_strict") if strict else mask


def node_windows(nodes: DataFrame, window: int = 10) -> DataFrame:
    """Per node: `contiguous` (last window+1 frames valid) and their mean speed (NULL if not)."""
    tail = F.slice("path", cfg.OBS_LEN - window, window + 1)
    speed = F.aggregate(tail, F.lit(0.0), lambda s, p: s + norm2(p["vx"], p["vy"])) / F.lit(float(window + 1))
    whole = F.forall(tail, lambda p: p["ok"])
    return nodes.select("scenario_id", "track_id", "cur_ok", "speed_current", whole.alias("contiguous"),
                        F.when(whole, speed).alias("window_speed"))


def with_windows(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds contiguity and mean speed of both endpoints to directed edges."""
    df = edges.drop(*[f"{s}_{c}" for s in ("src", "dst") for c in ("contiguous", "window_speed")])
    for side in ("src", "dst"):
        df = df.join(windows.select("scenario_id", F.col("track_id").alias(f"{side}_track_id"),
                                    F.col("contiguous").alias(f"{side}_contiguous"),
                                    F.col("window_speed").alias(f"{side}_window_speed")),
                     ["scenario_id", f"{side}_track_id"])
    return df


def oriented_edge(strict: bool = False) -> Column:
    """Eligible negative orientation: supervised, physical, label 0, destination contiguous, both present last."""
    return (usable_negative(strict) & F.col("dst_contiguous") & F.col("src_cur_ok") & F.col("dst_cur_ok"))


def usable_negative(strict: bool = False) -> Column:
    return (supervision_mask(strict) & F.col("dynamic_computable") & F.col("physical_possible")
            & (F.col("label_dynamic_risk") == 0))


def eligible_orientations(edges: DataFrame, strict: bool = False, both_ends: bool = False) -> DataFrame:
    """Orientations whose reverse edge is a usable negative as well; with `pair_lo`, `pair_hi`."""
    usable = edges.where(usable_negative(strict))
    back = usable.select("scenario_id", F.col("dst_track_id").alias("src_track_id"),
                         F.col("src_track_id").alias("dst_track_id"), F.col("edge_id").alias("reverse_edge_id"))
    chosen = edges.where(oriented_edge(strict))
    if both_ends:
        chosen = chosen.where(F.col("src_contiguous") & F.col("dst_contiguous"))
    return chosen.join(back, ["scenario_id", "src_track_id", "dst_track_id"]).withColumns({
        "pair_lo": F.least("src_track_id", "dst_track_id"), "pair_hi": F.greatest("src_track_id", "dst_track_id")})


def orient_pairs(orientations: DataFrame) -> DataFrame:
    """One orientation per pair: slowest destination, then destination id, source id, edge id.

    A pair has one or two orientations, kept by a minimum over a struct.
    """
    rest = [c for c in orientations.columns if c not in ("scenario_id", "pair_lo", "pair_hi")]
    key = F.struct(F.col("dst_window_speed"), F.col("dst_track_id"), F.col("src_track_id"), F.col("edge_id"))
    return orientations.groupBy("scenario_id", "pair_lo", "pair_hi").agg(
        F.min_by(F.struct(*rest), key).alias("_best"), F.count("*").alias("orientation_candidate_count"),
    ).select("scenario_id", "pair_lo", "pair_hi", "orientation_candidate_count", "_best.*")


def with_regime(pairs: DataFrame) -> DataFrame:
    """Adds the smaller endpoint speed and the speed regime."""
    return pairs.withColumn("min_endpoint_speed_mps", F.least("src_speed_current", "dst_speed_current")).withColumn(
        "motion_regime", motion_regime(F.col("min_endpoint_speed_mps")))


def seed_priority(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(int(seed))), *parts), 256)


def pair_priority(seed: int, scenario: Column, a: Column, b: Column, regime: Column) -> Column:
    """Priority of an unordered pair, the same in both directions."""
    return F.sha2(F.concat_ws(":", F.lit("pair-priority-v1"), F.lit(str(int(seed))), scenario, regime,
                              F.least(a, b), F.greatest(a, b)), 256)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the smallest by the given order; combines before shuffling."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")).select(*keys, "_best.*")


def seeded_pair(oriented: DataFrame, seed: int) -> DataFrame:
    """One pair per scenario by hash."""
    ordered = oriented.withColumn("_p", seed_priority(seed, F.col("scenario_id"), F.col("pair_lo"), F.col("pair_hi")))
    return first_by(ordered, ["scenario_id"], [F.col("_p"), F.col("pair_lo"), F.col("pair_hi")]).drop("_p")


def preferred_pair(candidates: DataFrame, regime: str = cfg.MOVING_REGIME) -> DataFrame:
    """One pair per scenario: the preferred regime if there is one, then the smallest priority."""
    if regime not in cfg.REGIME_WINDOWS:
        raise ValueError(f"unsupported regime: {regime!r}")
    return first_by(candidates, ["scenario_id"], [
        F.col("motion_regime") != regime, F.col("selection_priority_sha256"), F.col("pair_lo"), F.col("pair_hi")])


def sample_scenarios(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """Keeps round(n * rate) scenarios, at least one, by hash order; samples of one seed are nested.

    The cut is found by counting per hash prefix, so no window spans the
    table; only the prefix that holds the cut is ranked. `df` has one row per scenario.
    """
    # Ids and hashes only are written and ranked; the rows are joined once at the end.
    names = df.select("scenario_id").withColumn("_p", seed_priority(seed, F.col("scenario_id")))
    keyed = staged(names.withColumn("_b", F.substring("_p", 1, 3)), "sample-keys")
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    # At most 4096 prefixes.
    order = W.partitionBy(F.lit(0)).orderBy("_b")
    cut = counts.select(
        "_b", (F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"),
        F.greatest(F.bround(F.sum("_n").over(W.partitionBy(F.lit(0))) * F.lit(float(rate))), F.lit(1)).alias("_keep"))
    cut = cut.join(counts, "_b").where("_before < _keep")
    extra = ["_p", "_b", "_n", "_before", "_keep", "_rank"]
    whole = keyed.join(cut.where("_before + _n <= _keep"), "_b").drop(*extra)
    # One prefix at most holds the cut.
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_p", "scenario_id"))
    part = keyed.join(cut.where("_before + _n > _keep"), "_b").withColumn("_rank", rank).where("_before + _rank <= _keep").drop(*extra)
    return df.join(whole.unionByName(part), "scenario_id", "left_semi")


def in_split(edges: DataFrame, splits: DataFrame, split: str = "train") -> DataFrame:
    """Edges of the scenarios that a split table (scenario_id, split) puts into one split, with that split."""
    return edges.join(splits.where(F.col("split") == split).select("scenario_id", "split"), "scenario_id")


def fixed_fields(df: DataFrame, seed: int, risk: cfg.RiskConfig = cfg.RiskConfig(), strict: bool = False) -> DataFrame:
    """Adds the constant fields of a selection manifest, and src and dst from the node ids; the split is the rows' own."""
    if "split" not in df.columns:
        raise ValueError("the split of each row must be known; see in_split")
    ids = {s: F.col(f"{s}_node_id") for s in ("src", "dst") if f"{s}_node_id" in df.columns}
    return df.withColumns({**ids,
        "displacement_m": F.lit(0.2), "perturb_window": F.lit(10),
        "ramp_style": F.lit("minimum_jerk"), "velocity_mode": F.lit("residual"), "poison_label": F.lit(1),
        "seed": F.lit(int(seed)), "label_mode": F.lit(risk.label_mode), "label_config_hash": F.lit(risk.sha256()),
        "require_strict_label": F.lit(strict), "label_unit": F.lit(cfg.PAIR_LABEL_UNIT),
        "orientation_policy": F.lit(cfg.ORIENTATION_POLICY)})


def base_manifest(edges: DataFrame, rate: float, seed: int, risk: cfg.RiskConfig = cfg.RiskConfig(),
                  strict: bool = False) -> DataFrame:
    """Selection manifest over edges of one split: one seeded pair per eligible scenario, then a scenario sample."""
    pairs = orient_pairs(eligible_orientations(edges, strict))
    chosen = sample_scenarios(seeded_pair(pairs, seed), rate, seed)
    return fixed_fields(chosen, seed, risk, strict)


def manifest_volume(edges: DataFrame, manifest: DataFrame, strict: bool = False) -> DataFrame:
    """Volumes and rates of a selection manifest in one row."""
    orientations = eligible_orientations(edges, strict)
    pool = orientations.groupBy("scenario_id", "pair_lo", "pair_hi").agg(F.count("*").alias("n")).agg(
        F.count_distinct("scenario_id").alias("eligible_scenarios"), F.count("*").alias("eligible_negative_pairs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("eligible_orientations"))
    supervised = edges.where(supervision_mask(strict) & F.col("dynamic_computable")).agg(F.count("*").alias("supervised_edges"))
    chosen = manifest.agg(F.count("*").alias("selected_pairs"))
    one = pool.join(supervised).join(chosen)
    return one.withColumns({
        "selected_directed_labels": 2 * F.col("selected_pairs"),
        "realized_scenario_rate": ratio(F.col("selected_pairs"), F.col("eligible_scenarios")),
        "pair_rate": ratio(F.col("selected_pairs"), F.greatest(F.col("eligible_negative_pairs"), F.lit(1))),
        "directed_rate": ratio(2 * F.col("selected_pairs"), F.greatest(F.col("supervised_edges"), F.lit(1)))})


def regime_candidates(edges: DataFrame, seed: int, strict: bool = True) -> DataFrame:
    """Oriented pairs with both ends contiguous, regime and priority."""
    pairs = with_regime(orient_pairs(eligible_orientations(edges, strict, both_ends=True)))
    return pairs.withColumn("selection_priority_sha256", pair_priority(
        seed, F.col("scenario_id"), F.col("pair_lo"), F.col("pair_hi"), F.col("motion_regime")))


def regime_manifest(candidates: DataFrame, base: DataFrame, seed: int, regime: str = cfg.MOVING_REGIME,
                    risk: cfg.RiskConfig = cfg.RiskConfig()) -> DataFrame:
    """Regime-preferring choice for the scenarios of `base`, with the change against it."""
    c = F.col
    pool = candidates.join(base.select("scenario_id"), "scenario_id", "left_semi")
    stock = pool.groupBy("scenario_id").agg(
        F.count("*").alias("eligible_pair_count"),
        F.bool_or(c("motion_regime") == cfg.MOVING_REGIME).alias("moving_pair_available"),
        F.bool_or(c("motion_regime") == cfg.SLOW_REGIME).alias("slow_pair_available"))
    before = with_regime(base).select("scenario_id", c("pair_lo").alias("base_lo"), c("pair_hi").alias("base_hi"),
                                      c("motion_regime").alias("base_motion_regime"))
    chosen = preferred_pair(pool, regime).join(stock, "scenario_id").join(before, "scenario_id")
    return fixed_fields(chosen, seed, risk, True).withColumns({
        "pair_changed": (c("pair_lo") != c("base_lo")) | (c("pair_hi") != c("base_hi")),
        "preferred_motion_regime": F.lit(regime), "preferred_pair_available": c("motion_regime") == regime,
        "allocation_policy": F.lit(cfg.POLICY_SYMMETRIC), "allocation_alpha": F.lit(cfg.FIXED_ALPHA)})


def regime_change(manifest: DataFrame) -> DataFrame:
    """Counts by regime before and after, availability, and the share of changed pairs."""
    c = F.col
    return manifest.agg(
        F.count("*").alias("scenarios"),
        F.count_if(c("base_motion_regime") == cfg.SLOW_REGIME).alias("base_slow"),
        F.count_if(c("base_motion_regime") == cfg.MOVING_REGIME).alias("base_moving"),
        F.count_if(c("motion_regime") == cfg.SLOW_REGIME).alias("selected_slow"),
        F.count_if(c("motion_regime") == cfg.MOVING_REGIME).alias("selected_moving"),
        F.count_if("moving_pair_available").alias("with_moving_candidate"),
        F.count_if("slow_pair_available").alias("with_slow_candidate"),
        F.sum("eligible_pair_count").alias("candidate_pairs"), F.count_if("pair_changed").alias("changed_pairs"),
        F.avg(c("pair_changed").cast("double")).alias("changed_pair_rate"))


def schedule(manifest: DataFrame) -> DataFrame:
    """Window by regime; every other column stays."""
    windows = F.create_map(*[F.lit(v) for item in cfg.REGIME_WINDOWS.items() for v in item])
    return manifest.withColumns({"perturb_window": F.try_element_at(windows, F.col("motion_regime")),
                                 "trigger_schedule_id": F.lit(cfg.SCHEDULE_ID)})


# Key and column names of allocation tables.
PAIR_KEYS = ("scenario_id", "src", "dst", "src_track_id", "dst_track_id")
REPLACED = {
    "allocation_total_feature_energy": "total_feature_energy", "allocation_incident_edge_energy": "incident_edge_energy",
    "allocation_endpoint_node_energy": "endpoint_node_energy",
    "allocation_non_target_incident_edges": "non_target_incident_edges"}


def symmetric_manifest(source: DataFrame, candidates: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Source rows with the allocation of the matching alpha = 0.5 candidate of the same pair."""
    replaced = {**REPLACED, **(extra or {})}
    fixed = candidates.where(F.abs(F.col("alpha") - cfg.FIXED_ALPHA) <= 1e-12).select(
        *PAIR_KEYS, *[F.col(v).alias(f"_new_{k}") for k, v in replaced.items()],
        F.col("within_pair_feature_budget").alias("within_source_pair_feature_budget"))
    df = source.join(fixed, list(PAIR_KEYS)).withColumns({
        "source_allocation_alpha": F.col("allocation_alpha"),
        "fixed_to_source_energy_ratio": F.when(
            F.col("allocation_total_feature_energy") > 0,
            F.col("_new_allocation_total_feature_energy") / F.col("allocation_total_feature_energy"),
        ).otherwise(F.lit(float("inf"))),
        "allocation_policy": F.lit(cfg.POLICY_SYMMETRIC), "allocation_alpha": F.lit(cfg.FIXED_ALPHA)})
    return df.withColumns({k: F.col(f"_new_{k}") for k in replaced}).drop(*[f"_new_{k}" for k in replaced])


def check_symmetric(source: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every source pair has exactly one alpha = 0.5 candidate."""
    fixed = candidates.where(F.abs(F.col("alpha") - cfg.FIXED_ALPHA) <= 1e-12)
    return audit.combine(audit.unique(fixed, list(PAIR_KEYS), "unique_candidate"),
                         audit.covered(source, fixed, list(PAIR_KEYS), "candidate_exists"),
                         audit.unique(source, ["scenario_id"], "unique_source"))


def symmetric_summary(manifest: DataFrame) -> DataFrame:
    r = "fixed_to_source_energy_ratio"
    middle, p95 = quantiles(manifest, r, [0.5, 0.95])
    return manifest.agg(
        F.count("*").alias("rows"), F.count_if("within_source_pair_feature_budget").alias("within_budget"),
        F.count_if(~F.col("within_source_pair_feature_budget")).alias("outside_budget"),
        F.avg("allocation_total_feature_energy").alias("energy_mean"), F.lit(middle).cast("double").alias("ratio_median"),
        F.lit(p95).cast("double").alias("ratio_p95"), F.max(r).alias("ratio_max"))


def resolve_targets(manifest: DataFrame, edges: DataFrame, strict: bool = False, both_ends: bool = False) -> DataFrame:
    """Manifest rows with edge and reverse ids; NULL ids mark pairs that are no longer eligible."""
    live = eligible_orientations(edges, strict, both_ends).select(
        "scenario_id", "src_track_id", "dst_track_id", "edge_id", "reverse_edge_id")
    return manifest.drop("edge_id", "reverse_edge_id").join(live, ["scenario_id", "src_track_id", "dst_track_id"], "left")
