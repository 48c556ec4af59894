"""Leakage-resistant splits: fingerprints, components, assignment, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinepair.config import SPLITS, check_ratios
from kinepair.functions.order import quantiles
from kinepair.functions.ranks import running_totals
from kinepair.functions.scalar import finite, hash_fraction
from kinepair.functions.skew import matched
from kinepair.operators import audit
from kinepair.sources.staging import discard, staged, staged_with

GROUP_KEYS = ("recording_group_id_v2", "content_sha1", "focal_trajectory_hash_0p1m")
SOURCE_COLUMN = "recording_group_source_v2"


def check_metadata(meta: DataFrame, text: tuple[str, ...] = (*GROUP_KEYS, SOURCE_COLUMN)) -> DataFrame:
    """Violations of the group-metadata rules: filled text, finite ordered times, unique scenario."""
    c = F.col
    rules = {f"filled_{k}": audit.not_empty(c(k)) for k in ("scenario_id", "city", *text)}
    start, end = c("start_timestamp").cast("double"), c("end_timestamp").cast("double")
    rules.update({"finite_start": finite(start), "finite_end": finite(end), "ordered_interval": end >= start})
    return audit.combine(audit.violations(meta, ["scenario_id"], rules), audit.unique(meta, ["scenario_id"]))


def recorder_tokens(frames: DataFrame, segment: int = 3, stride: int = 1, quantum: float = 0.1) -> DataFrame:
    """Distinct (scenario_id, city, token) of short recorder-track segments on the absolute 0.1 s grid.

    All rows of a duplicated timestep are dropped; a segment needs consecutive
    timesteps; positions are rounded half-even to the quantum. A recording with a
    position that is missing or not finite among the rest, or without a finite start, has no token at all, so `check_tokens` names it.
    """
    if segment < 2 or stride < 1:
        raise ValueError("a segment has two frames or more and the stride is positive")
    c = F.col
    # One shuffle by recording: it serves this grouping and the windows, and the pieces are small enough to sort.
    taken = frames.where(c("track_id") == "AV").select("scenario_id", "city", "timestep", "position_x", "position_y", "start_timestamp")
    single = taken.repartition("scenario_id", "city").groupBy("scenario_id", "city", "timestep").agg(
        F.count("*").alias("_n"), F.min("position_x").cast("double").alias("x"),
        F.min("position_y").cast("double").alias("y"), F.min("start_timestamp").alias("start")).where("_n = 1")
    usable = F.coalesce(finite(c("x")) & finite(c("y")) & finite(c("start").cast("double")), F.lit(False))
    whole = F.min(usable.cast("int")).over(W.partitionBy("scenario_id", "city"))
    single = single.withColumn("_whole", whole).where("_whole = 1").withColumns({
        "bin": F.rint(c("start").cast("double") / 1e8).cast("bigint") + c("timestep"),
        "qx": F.rint(c("x") / F.lit(quantum)).cast("bigint"), "qy": F.rint(c("y") / F.lit(quantum)).cast("bigint")})
    order = W.partitionBy("scenario_id", "city").orderBy("timestep")
    parts: list[Column] = [c("bin"), c("qx"), c("qy")]
    df = single
    for k in range(1, segment):
        df = df.withColumns({f"_t{k}": F.lead("timestep", k).over(order), f"_qx{k}": F.lead("qx", k).over(order),
                             f"_qy{k}": F.lead("qy", k).over(order)})
        parts += [c(f"_qx{k}"), c(f"_qy{k}")]
    consecutive = F.lit(True)
    for k in range(1, segment):
        consecutive = consecutive & (c(f"_t{k}") == c("timestep") + k)
    token = F.substring(F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256), 1, 32)
    return df.where(consecutive & (F.pmod(c("bin"), F.lit(stride)) == 0)).select(
        "scenario_id", "city", token.alias("token")).distinct()


def check_tokens(meta: DataFrame, tokens: DataFrame) -> DataFrame:
    """Scenarios without any token: no recorder track, too short, or without finite positions. They could leak unseen."""
    missing = meta.select("scenario_id").distinct().join(tokens.select("scenario_id"), "scenario_id", "left_anti")
    return audit.violations(missing, ["scenario_id"], {"has_fingerprint": F.lit(False)})


def token_lists(tokens: DataFrame) -> DataFrame:
    """Sorted tokens of a scenario joined by '|'; a scenario has at most one token per frame."""
    return tokens.groupBy("scenario_id", "city").agg(
        F.array_join(F.array_sort(F.collect_set("token")), "|").alias("tokens"))


def _links(meta: DataFrame, tokens: DataFrame | None) -> DataFrame:
    """(scenario, key) memberships; keys are scoped by kind and city."""
    keyed = meta.select("scenario_id", F.explode(F.array(*[
        F.concat_ws("\0", F.lit(k), F.col("city"), F.col(k)) for k in GROUP_KEYS])).alias("key"))
    if tokens is not None:
        keyed = keyed.unionByName(tokens.select(
            "scenario_id", F.concat_ws("\0", F.lit("token"), F.col("city"), F.col("token")).alias("key")))
    return keyed


def _signed() -> tuple[Column, Column]:
    """Number of edges and an order-free sum over them."""
    return F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sign")


def connect(links: DataFrame) -> DataFrame:
    """Smallest scenario of the connected component of every scenario: (scenario_id, root).

    The memberships are written once. Each key links its scenarios to the smallest of them, so a key shared by very
    many scenarios adds one edge per scenario and no pairs. The much smaller edge table is then contracted by
    alternating large-star and small-star steps, logarithmic in the length of a chain. Minima and numbers of neighbours are
    partial aggregates; the joins that bring them back to the edges know these numbers and leave the rows of hubs in place (`matched`). Each
    step is written to the shared folder, which cuts the lineage and measures its edges; the end is a round that changes nothing.
    """
    members, found = staged_with(links.select("scenario_id", "key"), "memberships", F.count(F.lit(1)).alias("n"))
    hubs = members.groupBy("key").agg(F.min("scenario_id").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = matched(members, hubs, "key", "_n", found["n"]).where("scenario_id <> v").select(F.col("scenario_id").alias("u"), "v").distinct()
    edges, now = staged_with(first, "links", *_signed())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = matched(both, low, "u", "_n", 2 * now["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        middle, size = staged_with(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "stars", *_signed())
        low = middle.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        moved = matched(middle, low, "u", "_n", size["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, last = edges, now
        edges, now = staged_with(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links", *_signed())
        discard(middle)
        discard(before)
        if now == last:
            everyone = members.select("scenario_id").distinct()
            return everyone.join(edges.select(F.col("u").alias("scenario_id"), F.col("v").alias("root")),
                                 "scenario_id", "left").withColumn("root", F.coalesce("root", "scenario_id"))


def components(meta: DataFrame, tokens: DataFrame | None) -> DataFrame:
    """Metadata with `split_group_id`, the smallest recording group of the component.

    Recordings without a fingerprint are refused where fingerprints are given.
    """
    if tokens is not None:
        audit.require(check_tokens(meta, tokens))
    roots = connect(_links(meta, tokens))
    df, size = staged_with(meta.join(roots, "scenario_id"), "rooted", F.count(F.lit(1)).alias("n"))
    names = df.groupBy("root").agg(F.min(GROUP_KEYS[0]).alias("split_group_id"), F.count(F.lit(1)).alias("_n"))
    return matched(df, names, "root", "_n", size["n"]).drop("root", "_n")


def precomputed_components(meta: DataFrame, column: str) -> DataFrame:
    """Metadata with a given component column used as `split_group_id`."""
    return meta.withColumn("split_group_id", F.col(column).cast("string"))


def check_components(assigned: DataFrame) -> DataFrame:
    """A component stays in one city and merges no two explicit recording ids."""
    explicit = assigned.where(F.col(SOURCE_COLUMN).startswith("parquet_column:"))
    return audit.combine(
        audit.constant_within(assigned, ["split_group_id"], "city", "one_city"),
        audit.constant_within(explicit, ["split_group_id"], GROUP_KEYS[0], "one_explicit_recording"))


def assign_splits(assigned: DataFrame, seed: int, train: float = 0.70, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds `split`: whole components fall into train, val or test by a stable hash."""
    check_ratios(train, val, test)
    if seed < 0:
        raise ValueError("seed must be non-negative")
    part = hash_fraction(seed, F.col("city"), F.col("split_group_id"))
    return assigned.withColumn("split", F.when(part < train, SPLITS[0]).when(part < train + val, SPLITS[1]).otherwise(SPLITS[2]))


def apply_splits(manifest: DataFrame, assigned: DataFrame) -> DataFrame:
    """Manifest with the assigned split and component; an earlier split is replaced."""
    own = manifest.drop("split", "split_group_id")
    groups = assigned.select("scenario_id", F.col("city").alias("_city"), "split_group_id", "split")
    merged = own.join(groups, "scenario_id", "left")
    city = F.coalesce("city", "_city") if "city" in own.columns else F.col("_city")
    return merged.withColumn("city", city).drop("_city")


def check_apply(manifest: DataFrame, assigned: DataFrame) -> DataFrame:
    """Uniqueness, coverage and city agreement of a split application."""
    report = audit.one_to_one(manifest, assigned, ["scenario_id"])
    if "city" not in manifest.columns:
        return report
    both = manifest.where("city is not null").join(
        assigned.select("scenario_id", F.col("city").alias("_city")), "scenario_id")
    return audit.combine(report, audit.violations(both, ["scenario_id"], {"same_city": F.col("city") == F.col("_city")}))


def leakage(assigned: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Number of keys, tokens and components seen in more than one split, per kind."""
    keyed = assigned.select("split", F.explode(F.array(
        *[F.struct(F.lit(k).alias("kind"), F.concat_ws("\0", "city", k).alias("key")) for k in GROUP_KEYS],
        F.struct(F.lit("split_group_id").alias("kind"), F.col("split_group_id").alias("key")))).alias("_k")).select("split", "_k.*")
    if tokens is not None:
        keyed = keyed.unionByName(tokens.join(assigned.select("scenario_id", "split"), "scenario_id").select(
            "split", F.lit("token").alias("kind"), F.concat_ws("\0", "city", "token").alias("key")))
    spread = keyed.groupBy("kind", "key").agg(F.count_distinct("split").alias("_n"))
    return spread.groupBy("kind").agg(F.count_if(F.col("_n") > 1).alias("violations"))


def temporal_overlaps(meta: DataFrame, slices: int | None = None) -> DataFrame:
    """Same-city pairs with overlapping closed intervals, and those across splits, per city.

    Counted, not enumerated: a new interval overlaps the intervals that
    started before it and have not ended. Both counts are running totals over
    start and end events, per city and per (city, split).
    """
    def counts(keys: list[str]) -> DataFrame:
        starts = meta.select(*keys, F.col("start_timestamp").cast("double").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e"))
        ends = meta.select(*keys, F.col("end_timestamp").cast("double").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e"))
        # Equal times: all starts count before the ends (closed intervals).
        events = starts.unionByName(ends).groupBy(*keys, "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
        run = running_totals(events, keys, "at", ["s", "e"], slices=slices)
        before = F.col("s_total") - F.col("s") - (F.col("e_total") - F.col("e"))
        pairs = F.col("s") * before + (F.col("s") * (F.col("s") - 1) / 2).cast("bigint")
        return run.groupBy(*keys).agg(F.sum(pairs).alias("pairs"))

    total = counts(["city"]).withColumnRenamed("pairs", "overlap_pairs")
    within = counts(["city", "split"]).groupBy("city").agg(F.sum("pairs").alias("_same"))
    return total.join(within, "city").select(
        "city", "overlap_pairs", (F.col("overlap_pairs") - F.col("_same")).alias("cross_split_pairs"))


def component_sizes(assigned: DataFrame) -> DataFrame:
    sizes = staged(assigned.groupBy("split_group_id").agg(F.count("*").alias("_n")), "component-sizes")
    middle, p95, p99 = quantiles(sizes, "_n", [0.5, 0.95, 0.99])
    return sizes.agg(F.count("*").alias("num_components"), *[F.lit(v).cast("double").alias(k) for k, v in (("median", middle), ("p95", p95), ("p99", p99))], F.max("_n").alias("max_size"))


def largest_components(assigned: DataFrame, n: int = 10) -> DataFrame:
    sizes = assigned.groupBy("split_group_id").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "split_group_id").limit(n)


def city_split_matrix(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("city").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def check_contract(contract: dict, expected: dict) -> list[str]:
    """Names of contract fields that differ from what is expected."""
    return sorted(k for k, v in expected.items() if contract.get(k) != v)
