"""Table constraints.

Every check returns rows (rule, key, detail, n); a clean table gives none.
`require` turns violations into an exception on the driver, reading at most a
handful of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair import config as cfg
from kinepair.functions.scalar import finite, strict_boolean, strict_integer

HEX64 = "^[0-9a-f]{64}$"


class ConstraintError(ValueError):
    """A table breaks at least one of its constraints."""


def _key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys])


def _report(df: DataFrame, rule: str, key: Column, detail: Column, n: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"),
                     detail.cast("string").alias("detail"), n.cast("bigint").alias("n"))


def combine(*reports: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def require(report: DataFrame) -> None:
    """Raises if the report has rows."""
    rows = report.limit(5).collect()
    if rows:
        raise ConstraintError("; ".join(f"{r.rule}: {r.key} ({r.detail}, n={r.n})" for r in rows))


def require_columns(df: DataFrame, columns: set[str] | list[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ConstraintError(f"missing columns: {missing}")


def unique(df: DataFrame, keys: list[str], rule: str = "unique") -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return _report(groups, rule, _key(keys), F.lit("duplicate key"), F.col("_n"))


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per rule and key whose condition is not true (NULL counts as broken)."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    broken = df.select(_key(keys).alias("_k"), F.explode(F.array_compact(F.array(*checks))).alias("_rule"))
    return broken.groupBy("_rule", "_k").agg(F.count("*").alias("_n")).select(
        F.col("_rule").alias("rule"), F.col("_k").alias("key"), F.lit("condition not met").alias("detail"),
        F.col("_n").cast("bigint").alias("n"))


def not_empty(c: Column) -> Column:
    return c.isNotNull() & (F.length(c.cast("string")) > 0)


def whole_number(c: Column, minimum: int = 0) -> Column:
    return F.coalesce(strict_integer(c) >= minimum, F.lit(False))


def hex_digest(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(HEX64), F.lit(False))


def constant_within(df: DataFrame, keys: list[str], column: str, rule: str = "constant_within") -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count_distinct(column).alias("_n")).where("_n > 1")
    return _report(groups, rule, _key(keys), F.lit(f"{column} varies"), F.col("_n"))


def covered(left: DataFrame, right: DataFrame, keys: list[str], rule: str = "covered") -> DataFrame:
    lost = left.join(right.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.count("*").alias("_n"))
    return _report(lost, rule, _key(keys), F.lit("no partner"), F.col("_n"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides unique on the keys and every left row matched."""
    return combine(unique(left, keys, "left_unique"), unique(right, keys, "right_unique"), covered(left, right, keys))


def disjoint(left: DataFrame, right: DataFrame, keys: list[str], rule: str = "disjoint") -> DataFrame:
    shared = left.select(*keys).intersect(right.select(*keys))
    return _report(shared, rule, _key(keys), F.lit("in both"), F.lit(1))


def same_set(left: DataFrame, right: DataFrame, keys: list[str], rule: str = "same_set") -> DataFrame:
    a, b = left.select(*keys), right.select(*keys)
    return combine(_report(a.exceptAll(b).groupBy(*keys).count(), rule, _key(keys), F.lit("only left"), F.col("count")),
                   _report(b.exceptAll(a).groupBy(*keys).count(), rule, _key(keys), F.lit("only right"), F.col("count")))


SELECTION_COLUMNS = (
    "scenario_id", "split", "src", "dst", "src_track_id", "dst_track_id", "displacement_m", "perturb_window",
    "ramp_style", "velocity_mode", "poison_label", "seed", "label_mode", "label_config_hash",
    "require_strict_label", "label_unit")


def selection_manifest(df: DataFrame, risk: cfg.RiskConfig = cfg.RiskConfig(), split: str = "train",
                       strict: bool = False, scheduled: bool = False) -> DataFrame:
    """All rules of a selection manifest; allocation columns are checked when present."""
    require_columns(df, list(SELECTION_COLUMNS) + (["trigger_schedule_id", "motion_regime"] if scheduled else []))
    if ("allocation_policy" in df.columns) != ("allocation_alpha" in df.columns):
        raise ConstraintError("allocation_policy and allocation_alpha come together")
    c = F.col
    window = strict_integer(c("perturb_window"))
    if scheduled:
        expected = F.when(c("motion_regime") == cfg.SLOW_REGIME, cfg.REGIME_WINDOWS[cfg.SLOW_REGIME]).when(
            c("motion_regime") == cfg.MOVING_REGIME, cfg.REGIME_WINDOWS[cfg.MOVING_REGIME])
    else:
        expected = F.lit(10)
    # What the protocol asks of a selection manifest.
    rules = {
        "split": c("split") == split,
        "label_mode": c("label_mode") == risk.label_mode,
        "label_config_hash": c("label_config_hash") == risk.sha256(),
        "require_strict_label": strict_boolean(c("require_strict_label")) == F.lit(strict),
        "label_unit": c("label_unit") == cfg.PAIR_LABEL_UNIT,
        "displacement_m": F.abs(c("displacement_m").cast("double") - 0.2) <= 1e-12,
        "perturb_window": window == expected,
        "ramp_style": c("ramp_style") == "minimum_jerk",
        "velocity_mode": c("velocity_mode") == "residual",
        "poison_label": strict_integer(c("poison_label")) == 1,
        **{name: whole_number(c(name)) for name in ("src", "dst", "seed")},
    }
    if scheduled:
        rules["trigger_schedule_id"] = c("trigger_schedule_id") == cfg.SCHEDULE_ID
    reports = [unique(df, ["scenario_id"], "one_target_per_scenario")]
    if "allocation_policy" in df.columns:
        alpha = c("allocation_alpha").cast("string").try_cast("double")
        rules["allocation_policy"] = c("allocation_policy").isin(*cfg.ALLOCATION_POLICIES)
        rules["allocation_alpha"] = finite(alpha) & alpha.between(0.0, 1.0) & (
            F.when(c("allocation_policy") == cfg.POLICY_SINGLE, F.abs(alpha) <= 1e-12)
            .when(c("allocation_policy") == cfg.POLICY_SYMMETRIC, F.abs(alpha - cfg.FIXED_ALPHA) <= 1e-12)
            .otherwise(F.lit(True)))
        reports.append(one_value(df, "allocation_policy"))
    if "orientation_policy" in df.columns:
        rules["orientation_policy"] = c("orientation_policy") == cfg.ORIENTATION_POLICY
    return combine(violations(df, ["scenario_id"], rules), *reports)


def one_value(df: DataFrame, column: str, rule: str = "one_value") -> DataFrame:
    """The whole table holds exactly one value of the column."""
    count = df.agg(F.count_distinct(column).alias("_n")).where("_n <> 1")
    return _report(count, rule, F.lit(column), F.lit("distinct values"), F.col("_n"))


BINDING_COLUMNS = ("surrogate_checkpoint_sha256", "surrogate_fit_manifest_sha256", "surrogate_score_manifest_sha256")


def crossfit_bindings(df: DataFrame, expected: DataFrame, folds: DataFrame, num_folds: int = 3) -> DataFrame:
    """Cross-fit provenance of a selection manifest.

    `expected` holds one row per fold with the digests of its model and
    manifests; `folds` the outer fold of every scenario.
    """
    c = F.col
    rules = {
        "fold_in_range": c("scenario_shadow_fold").between(0, num_folds - 1),
        "fold_is_held_out": c("scenario_shadow_fold") == c("surrogate_heldout_fold"),
        "protocol": c("surrogate_protocol") == cfg.CROSSFIT_PROTOCOL,
        **{f"digest_{b}": hex_digest(c(b)) for b in BINDING_COLUMNS},
    }
    want = expected.select(c("fold").alias("scenario_shadow_fold"), *[c(b).alias(f"_want_{b}") for b in BINDING_COLUMNS])
    bound = df.join(want, "scenario_shadow_fold", "left")
    matches = violations(bound, ["scenario_id"], {
        f"bound_{b}": F.lower(c(b)) == F.lower(c(f"_want_{b}")) for b in BINDING_COLUMNS})
    lookup = df.join(folds.select("scenario_id", c("shadow_fold").alias("_fold")), "scenario_id", "left")
    agrees = violations(lookup, ["scenario_id"], {"outer_fold": c("_fold") == c("scenario_shadow_fold")})
    distinct = expected.agg(F.count_distinct("fold").alias("f"), F.count_distinct(BINDING_COLUMNS[0]).alias("m"),
                            F.count("*").alias("_n")).where(
        (c("f") != num_folds) | (c("m") != num_folds) | (c("_n") != num_folds))
    empty_folds = expected.select(c("fold").alias("scenario_shadow_fold")).join(
        df.select("scenario_shadow_fold").distinct(), "scenario_shadow_fold", "left_anti")
    return combine(
        violations(df, ["scenario_id"], rules), matches, agrees,
        *[constant_within(df, ["scenario_id"], b, "one_binding_per_scenario") for b in BINDING_COLUMNS],
        _report(distinct, "distinct_models", F.lit("expected"), F.lit("folds and models must be distinct"), c("_n")),
        _report(empty_folds, "fold_has_rows", c("scenario_shadow_fold"), F.lit("no rows"), F.lit(0)))
