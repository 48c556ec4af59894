"""Dynamic-risk labels from future pair distances.

Everything a step needs lies in a few neighbouring steps: the local fit uses
the whole odd window around it, and whether it belongs to a long enough
violating run depends on the next few margins. So every generated pair step
carries its own verdict and the label is a plain aggregate; runs are measured
on 60-bit masks of valid and violating steps.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.config import OBS_LEN, RiskConfig
from kinepair.functions.scalar import norm2

RISK_COLUMNS = (
    "label_dynamic_risk", "dynamic_computable", "dynamic_margin_min", "dynamic_risk_step",
    "closing_speed_at_risk", "threshold_at_risk", "violation_run_max",
)
PARAMETERS = ("_base", "_reaction", "_decel")


def _distance(step: Column) -> Column:
    f, g = F.get(F.col("a_future"), step), F.get(F.col("b_future"), step)
    return norm2(g["x"] - f["x"], g["y"] - f["y"])


def closing_fit(distances: list[Column], dt: float) -> Column:
    """max(0, -slope) over a complete odd window, NULL if any distance is missing."""
    half = len(distances) // 2
    offsets = [o * dt for o in range(-half, half + 1)]
    dot = reduce(lambda a, b: a + b, [F.lit(o) * d for o, d in zip(offsets, distances)])
    slope = dot / F.lit(sum(o * o for o in offsets))
    return F.when(slope.isNotNull(), F.greatest(F.lit(0.0), -slope))


def risk_steps(steps: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Adds to pair steps: `closing`, `limit`, `margin` and `in_run` (violating and in a long enough run)."""
    half, reach = cfg.closing_speed_window_frames // 2, cfg.min_risk_consecutive_frames - 1
    i = F.col("t") - OBS_LEN
    span = range(-reach - half, reach + half + 1)
    # Negative positions give NULL, as positions behind the end do.
    df = steps.withColumns({f"_d{k + 100}": F.when(i + k >= 0, _distance(i + k)) for k in span})
    df = df.withColumns({f"_c{k + 100}": closing_fit(
        [F.col(f"_d{k + o + 100}") for o in range(-half, half + 1)], cfg.future_dt_seconds)
        for k in range(-reach, reach + 1)})
    base, reaction, decel = (
        F.col(p) if p in steps.columns else F.lit(v) for p, v in zip(
            PARAMETERS, (cfg.risk_base_distance_m, cfg.risk_reaction_time_s, cfg.risk_safe_decel_mps2)))

    def limit(k: int) -> Column:
        c = F.col(f"_c{k + 100}")
        return base + reaction * c + c * c / (F.lit(2.0) * decel)

    df = df.withColumns({f"_m{k + 100}": F.col(f"_d{k + 100}") - limit(k) for k in range(-reach, reach + 1)})
    bad = {k: F.coalesce(F.col(f"_m{k + 100}") <= 0, F.lit(False)) for k in range(-reach, reach + 1)}
    runs = [reduce(lambda a, b: a & b, [bad[k] for k in range(start, start + reach + 1)])
            for start in range(-reach, 1)]
    future = F.col("t") >= OBS_LEN
    df = df.withColumns({
        "closing": F.when(future, F.col("_c100")), "limit": F.when(future, limit(0)),
        "margin": F.when(future, F.col("_m100")), "in_run": future & reduce(lambda a, b: a | b, runs)})
    return df.drop(*[c for c in df.columns if c[:2] in ("_d", "_c", "_m") and c[2:].isdigit()])


def risk_aggregates() -> list[Column]:
    m, step = F.col("margin"), F.col("t") - OBS_LEN
    bit = F.expr(f"shiftleft(1L, t - {OBS_LEN})")
    q = F.when(F.col("in_run"), m)
    return [
        F.bit_or(F.when(m.isNotNull(), bit)).alias("_valid_mask"), F.bit_or(F.when(m <= 0, bit)).alias("_bad_mask"),
        F.min(m).alias("_all_margin"), F.min_by(step, m).alias("_all_step"),
        F.min_by("closing", m).alias("_all_closing"), F.min_by("limit", m).alias("_all_limit"),
        F.min(q).alias("_run_margin"), F.min_by(step, q).alias("_run_step"),
        F.min_by("closing", q).alias("_run_closing"), F.min_by("limit", q).alias("_run_limit")]


def longest_run(mask: Column) -> Column:
    """Longest stretch of set bits; 0 for an empty or missing mask."""
    return F.coalesce(F.array_max(F.transform(F.split(F.bin(mask), "0"), F.length)), F.lit(0))


def finish_risk(df: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Label, computability and diagnostics at the smallest margin (of qualifying runs, else of all steps)."""
    run = cfg.min_risk_consecutive_frames
    c = F.col
    df = df.withColumns({"_valid_run": longest_run(c("_valid_mask")), "_bad_run": longest_run(c("_bad_mask"))})
    df = df.withColumns({"dynamic_computable": c("_valid_run") >= run,
                         "_positive": (c("_valid_run") >= run) & (c("_bad_run") >= run)})

    def at(name: str) -> Column:
        return F.when(c("dynamic_computable"), F.when(c("_positive"), c(f"_run_{name}")).otherwise(c(f"_all_{name}")))

    df = df.withColumns({
        "label_dynamic_risk": c("_positive").cast("int"),
        "dynamic_margin_min": at("margin"), "dynamic_risk_step": at("step"),
        "closing_speed_at_risk": at("closing"), "threshold_at_risk": at("limit"),
        "violation_run_max": F.when(c("dynamic_computable"), c("_bad_run")).otherwise(F.lit(0))})
    if "label_config_hash" not in df.columns:
        df = df.withColumn("label_config_hash", F.lit(cfg.sha256()))
    return df.drop("_valid_mask", "_bad_mask", "_valid_run", "_bad_run", "_positive",
                   *[f"_{a}_{b}" for a in ("all", "run") for b in ("margin", "step", "closing", "limit")])


def dynamic_risk(pairs: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Risk columns per unordered pair, from joined pairs with their arrays."""
    from kinepair.operators.pairs import summarise_pairs

    return summarise_pairs(pairs, risk=cfg, parts=())


FRAMES = 60


def run_lengths(mask: Column) -> Column:
    """For each of the 60 future steps the length of the run of set bits that it lies in, 0 for a clear bit."""
    bits = F.reverse(F.lpad(F.bin(F.coalesce(mask, F.lit(0).cast("bigint"))), FRAMES, "0"))
    # Every run gives its length once for each of its bits, every clear bit a 0.
    return F.slice(F.flatten(F.transform(F.split(bits, "0"), lambda run: F.concat(F.array_repeat(F.length(run), F.length(run)), F.array(F.lit(0))))), 1, FRAMES)


def risk_grid(pairs: DataFrame, configs: list[RiskConfig]) -> DataFrame:
    """One row per pair and parameter set over shared steps.

    The sets share time step and regression window. Steps are generated once for each pair and limit, whatever the run lengths asked for: the margins of the at
    most 60 steps are kept in one array, the run around each step comes from the mask of violations, and each run length takes the smallest margin among the
    steps in runs that are long enough.
    """
    from kinepair.operators.pairs import pair_frames

    shared = {(c.future_dt_seconds, c.closing_speed_window_frames) for c in configs}
    if len(shared) != 1:
        raise ValueError("a grid needs one time step and one regression window")
    limits: dict[tuple, list[RiskConfig]] = {}
    for c in configs:
        limits.setdefault((c.risk_base_distance_m, c.risk_reaction_time_s, c.risk_safe_decel_mps2), []).append(c)
    sets = lambda group: F.array(*[F.struct(F.lit(c.min_risk_consecutive_frames).alias("run"), F.lit(c.sha256()).alias("hash")) for c in group])
    params = F.array(*[F.struct(*[F.lit(v).alias(p) for p, v in zip(PARAMETERS, limit)], sets(group).alias("_sets")) for limit, group in limits.items()])
    grid = pairs.withColumn("_p", F.explode(params)).select("*", "_p.*").drop("_p")
    ids = [c for c in ("scenario_id", "city", "variant", "a_track_id", "b_track_id") if c in pairs.columns]
    single = replace(configs[0], min_risk_consecutive_frames=1)
    steps = risk_steps(pair_frames(grid, keep=(*PARAMETERS, "_sets"), first=OBS_LEN), single)
    m, step = F.col("margin"), F.col("t") - OBS_LEN
    bit = F.expr(f"shiftleft(1L, t - {OBS_LEN})")
    row = F.struct(m.alias("margin"), step.alias("step"), F.col("closing").alias("closing"), F.col("limit").alias("limit"))
    df = steps.groupBy(*ids, *PARAMETERS).agg(
        F.first("_sets").alias("_sets"), F.bit_or(F.when(m.isNotNull(), bit)).alias("_valid_mask"), F.bit_or(F.when(m <= 0, bit)).alias("_bad_mask"),
        F.collect_list(F.when(m.isNotNull(), row)).alias("_steps"))
    df = df.withColumns({"_lengths": run_lengths(F.col("_bad_mask")), "_valid_run": longest_run(F.col("_valid_mask")), "_bad_run": longest_run(F.col("_bad_mask"))})
    each = df.withColumn("_set", F.explode("_sets")).withColumns({"run": F.col("_set.run"), "label_config_hash": F.col("_set.hash")})
    c = F.col
    positive, computable = (c("_valid_run") >= c("run")) & (c("_bad_run") >= c("run")), c("_valid_run") >= c("run")
    # Least margin, then the earliest step.
    inside = F.array_min(F.filter("_steps", lambda s: F.get(c("_lengths"), s["step"]) >= c("run")))
    best = F.when(positive, inside).when(computable, F.array_min("_steps"))
    out = each.withColumns({"_best": best, "dynamic_computable": computable, "label_dynamic_risk": positive.cast("int"),
                            "violation_run_max": F.when(computable, c("_bad_run")).otherwise(F.lit(0)), "min_risk_consecutive_frames": c("run")})
    return out.select(*ids, "label_config_hash", c("_base").alias("risk_base_distance_m"), c("_reaction").alias("risk_reaction_time_s"),
                      c("_decel").alias("risk_safe_decel_mps2"), "min_risk_consecutive_frames", "dynamic_computable", "label_dynamic_risk",
                      c("_best.margin").alias("dynamic_margin_min"), c("_best.step").alias("dynamic_risk_step"), c("_best.closing").alias("closing_speed_at_risk"),
                      c("_best.limit").alias("threshold_at_risk"), "violation_run_max")


def selected_computable(edges: DataFrame) -> DataFrame:
    """Adds `selected_computable`: stored computability and dynamic computability."""
    stored = F.col("label_computable") if "label_computable" in edges.columns else F.lit(True)
    return edges.withColumn("selected_computable", stored & F.col("dynamic_computable"))
