"""Queries over splits, folds and table constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinepair.functions.scalar import strict_boolean
from kinepair.operators import audit, folds, splits
from kinepair.plans import fixtures
from kinepair.plans.catalogue import query, r6
from kinepair.plans.oracle_views import VIEWS, r
from kinepair.sources.staging import staged

SEED = 20260621
REPORT = ["rule", "key", "n"]


def _segments(k: int) -> str:
    lead = ", ".join(f"lead(timestep, {i}) over w t{i}, lead(qx, {i}) over w x{i}, lead(qy, {i}) over w y{i}" for i in range(1, k))
    text = "concat_ws(',', bin, qx, qy" + "".join(f", x{i}, y{i}" for i in range(1, k)) + ")"
    cond = " and ".join(f"t{i} = timestep + {i}" for i in range(1, k))
    return f"""select distinct scenario_id, city, substr(sha256({text}), 1, 32) token from (select *, {lead} from (
  select scenario_id, city, timestep, cast(round_even(min(start_timestamp)/1e8, 0) as bigint) + timestep bin,
    cast(round_even(min(position_x)/0.1, 0) as bigint) qx, cast(round_even(min(position_y)/0.1, 0) as bigint) qy
  from av_frames where track_id = 'AV' group by 1, 2, timestep having count(*) = 1)
  window w as (partition by scenario_id, city order by timestep)) where {cond}"""


VIEWS["tokens"] = _segments(3)
VIEWS["memberships"] = """select scenario_id, 'r' || chr(0) || city || chr(0) || recording_group_id_v2 k from group_meta
  union all select scenario_id, 'c' || chr(0) || city || chr(0) || content_sha1 from group_meta
  union all select scenario_id, 'f' || chr(0) || city || chr(0) || focal_trajectory_hash_0p1m from group_meta
  union all select scenario_id, 't' || chr(0) || city || chr(0) || token from tokens"""
VIEWS["links"] = "select distinct a.scenario_id u, b.scenario_id v from memberships a join memberships b using (k)"


def _recursive(final: str) -> str:
    """Adds transitive closure, which needs a recursive view, to a composed query."""
    from kinepair.plans.oracle_views import compose

    head = compose("select * from links")
    body = head[: head.rindex("\nselect * from links")]
    body = "with recursive " + body[len("with "):]
    closure = """,
closure(u, v) as (select u, v from links union select c.u, l.v from closure c join links l on l.u = c.v),
roots as (select u scenario_id, min(v) root from closure group by 1),
comp as (select m.*, min(recording_group_id_v2) over (partition by root) split_group_id from group_meta m join roots using (scenario_id)),
split as (select *, case when f < 0.70 then 'train' when f < 0.85 then 'val' else 'test' end split from (select *,
  cast(cast('0x' || substr(sha256('20260621' || chr(0) || city || chr(0) || split_group_id), 1, 16) as ubigint) as double)
  / 18446744073709551616.0 f from comp))
"""
    return body + closure + final


def register(name: str, final: str):
    """Registers a query whose check needs the components."""
    from kinepair.plans import catalogue

    def deco(fn):
        catalogue.QUERIES[name] = fn
        catalogue.ORACLES[name] = _recursive(final)
        return fn
    return deco


_CACHE: dict = {}


def tokens(spark, d):
    return splits.recorder_tokens(fixtures.av_frames(spark, d))


def component_table(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _CACHE:
        t = staged(tokens(spark, d), "tokens")
        _CACHE[key] = (staged(splits.components(fixtures.group_meta(spark, d), t), "components"), t)
    return _CACHE[key][0]


def token_table(spark, d):
    component_table(spark, d)
    return _CACHE[(spark.sparkContext.applicationId, d)][1]


def split_table(spark, d):
    return splits.assign_splits(component_table(spark, d), SEED)


@query("p01_metadata_rules", """select rule, key, n from (
  select 'ordered_interval' rule, scenario_id key, count(*) n from broken_meta where end_timestamp < start_timestamp group by 2
  union all select 'filled_content_sha1', scenario_id, count(*) from broken_meta where coalesce(length(content_sha1), 0) = 0 group by 2
  union all select 'unique', scenario_id, count(*) from broken_meta group by 2 having count(*) > 1)""", {"broken_meta": """select scenario_id, city,
  recording_group_id_v2, case when start_timestamp % 3 = 0 then '' else content_sha1 end content_sha1, start_timestamp,
  case when start_timestamp % 7 = 0 then start_timestamp - 1 else end_timestamp end end_timestamp from group_meta
  union all select scenario_id, city, recording_group_id_v2, content_sha1, start_timestamp, end_timestamp from group_meta where city = 'city0'"""})
def p01(spark, d):
    m = fixtures.group_meta(spark, d)
    bad = m.withColumns({
        "content_sha1": F.when(F.col("start_timestamp") % 3 == 0, "").otherwise(F.col("content_sha1")),
        "end_timestamp": F.when(F.col("start_timestamp") % 7 == 0, F.col("start_timestamp") - 1).otherwise(F.col("end_timestamp"))})
    return splits.check_metadata(bad.unionByName(m.where("city = 'city0'"))).select(*REPORT)


@query("p02_recorder_tokens", "select scenario_id, city, token from tokens")
def p02(spark, d):
    return tokens(spark, d)


@query("p02b_two_frame_tokens", "select scenario_id, city, token from tokens", {"tokens": _segments(2)})
def p02b(spark, d):
    return splits.recorder_tokens(fixtures.av_frames(spark, d), segment=2)


@register("p03_components", "select scenario_id, city, split_group_id from comp")
def p03(spark, d):
    return component_table(spark, d).select("scenario_id", "city", "split_group_id")


@register("p04_temporal_overlaps", """select a.city, count(*) overlap_pairs, count(*) filter (a.split <> b.split) cross_split_pairs
  from split a join split b on a.city = b.city and a.scenario_id < b.scenario_id and a.start_timestamp <= b.end_timestamp
  and b.start_timestamp <= a.end_timestamp group by 1""")
def p04(spark, d):
    return splits.temporal_overlaps(split_table(spark, d)).where("overlap_pairs > 0").select("city", "overlap_pairs", "cross_split_pairs")


@query("p04b_order_overlaps", """select count(*) overlap_pairs from spans a join spans b
  on a.city = b.city and a.id < b.id and a.s <= b.e and b.s <= a.e""", {"spans": """select city, id, least(s, e) s, greatest(s, e) e from (
  select o_custkey city, o_orderkey id, min(epoch_us(o_orderdate)) s, max(epoch_us(l_shipdate)) e
  from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)"""})
def p04b(spark, d):
    ship = fixtures.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    a, b = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("o_orderdate", "last"))
    iv = fixtures.table(spark, d, "orders").join(ship, "o_orderkey").select(
        F.col("o_custkey").alias("city"), F.least(a, b).alias("start_timestamp"), F.greatest(a, b).alias("end_timestamp"),
        F.lit("all").alias("split"))
    return splits.temporal_overlaps(iv).agg(F.sum("overlap_pairs").alias("overlap_pairs"))


@query("p05_hash_fraction", f"""select scenario_id, {r('''cast(cast('0x' || substr(sha256('7' || chr(0) || city || chr(0) || scenario_id), 1, 16)
  as ubigint) as double) / 18446744073709551616.0''', 9)} fraction from group_meta""")
def p05(spark, d):
    from kinepair.functions.scalar import hash_fraction

    return fixtures.group_meta(spark, d).select("scenario_id", r6(hash_fraction(7, F.col("city"), F.col("scenario_id")), 9).alias("fraction"))


@register("p06_split_assignment", "select scenario_id, split_group_id, split from split")
def p06(spark, d):
    return split_table(spark, d).select("scenario_id", "split_group_id", "split")


@register("p07a_apply_splits", "select scenario_id, city, 'built' status, split_group_id, split from split")
def p07a(spark, d):
    manifest = fixtures.group_meta(spark, d).select("scenario_id", "city", F.lit("built").alias("status"), F.lit("old").alias("split"))
    return splits.apply_splits(manifest, split_table(spark, d)).select("scenario_id", "city", "status", "split_group_id", "split")


@register("p07b_leakage", """select 'recording_group_id_v2' kind, cast(0 as bigint) violations union all select 'content_sha1', 0 union all
  select 'focal_trajectory_hash_0p1m', 0 union all select 'split_group_id', 0
  union all select 'token', count(*) from (select t.city, token from tokens t join split using (scenario_id) group by 1, 2 having count(distinct split) > 1)""")
def p07b(spark, d):
    return splits.leakage(split_table(spark, d), token_table(spark, d))


@query("p07b_exact_copies", """select lang, count(*) groups from (select lang, sha1(text) h from documents group by 1, 2 having count(*) > 1) group by 1""")
def p07b_documents(spark, d):
    docs = fixtures.table(spark, d, "documents").select("lang", F.sha1("text").alias("h"))
    return docs.groupBy("lang", "h").agg(F.count("*").alias("n")).where("n > 1").groupBy("lang").agg(F.count("*").alias("groups"))


@register("p07c_component_sizes", f"""select count(*) num_components, {r('quantile_cont(n, 0.5)')} median, {r('quantile_cont(n, 0.95)')} p95,
  {r('quantile_cont(n, 0.99)')} p99, max(n) max_size from (select split_group_id, count(*) n from comp group by 1)""")
def p07c(spark, d):
    s = splits.component_sizes(component_table(spark, d))
    return s.select("num_components", *[r6(c).alias(c) for c in ("median", "p95", "p99")], "max_size")


@register("p07c_largest", "select split_group_id, count(*) size from comp group by 1 order by size desc, split_group_id limit 10")
def p07c_largest(spark, d):
    return splits.largest_components(component_table(spark, d))


@register("p07d_city_split", "select city, " + ", ".join(
    f"count(*) filter (split = '{s}') {s}" for s in ("train", "val", "test")) + " from split group by 1")
def p07d(spark, d):
    return splits.city_split_matrix(split_table(spark, d))


@query("p08_explicit_recordings", """select 'one_explicit_recording' rule, city key, count(distinct recording_group_id_v2) n from group_meta
  where content_sha1 like 'a%' group by 2 having count(distinct recording_group_id_v2) > 1""")
def p08(spark, d):
    m = fixtures.group_meta(spark, d).withColumn("recording_group_source_v2", F.when(
        F.col("content_sha1").startswith("a"), "parquet_column:log_id").otherwise("derived"))
    return splits.check_components(splits.precomputed_components(m, "city")).select(*REPORT)


# Folds. The fold of a group is its hash modulo three, in both engines.
VIEWS["fold_manifest"] = """select scenario_id, city, 'built' status, 'g/' || scenario_id graph_path, sha256(scenario_id) graph_sha256, 'train' split,
  recording_group_id_v2 split_group_id, cast(substr(scenario_id, 2, 1) = '1' as bigint) + 3 num_risk_positive_edges, cast(10 as bigint) num_supervision_edges
  from group_meta"""
VIEWS["fold_table"] = """select scenario_id, split_group_id, city, 'train' source_split,
  cast(cast('0x' || substr(sha256('11:' || split_group_id), 1, 16) as ubigint) % 3 as integer) shadow_fold, graph_sha256 from fold_manifest"""


def manifest_table(spark, d):
    return fixtures.group_meta(spark, d).select(
        "scenario_id", "city", F.lit("built").alias("status"), F.concat(F.lit("g/"), "scenario_id").alias("graph_path"),
        F.sha2("scenario_id", 256).alias("graph_sha256"), F.lit("train").alias("split"),
        F.col("recording_group_id_v2").alias("split_group_id"),
        ((F.substring("scenario_id", 2, 1) == "1").cast("bigint") + 3).alias("num_risk_positive_edges"),
        F.lit(10).cast("bigint").alias("num_supervision_edges"))


def fold_table(spark, d):
    return manifest_table(spark, d).withColumns({
        "source_split": F.lit("train"),
        "shadow_fold": F.pmod(folds.fold_priority(11, F.col("split_group_id")), F.lit(3)).cast("int")}).select(*folds.FOLD_COLUMNS)


@query("f01_fold_priority", "select scenario_id, cast(cast('0x' || substr(sha256('11:' || split_group_id), 1, 16) as ubigint) as varchar) priority from fold_table")
def f01(spark, d):
    return manifest_table(spark, d).select("scenario_id", folds.fold_priority(11, F.col("split_group_id")).cast("string").alias("priority"))


DEALT = """select city, split_group_id, cast((row_number() over (partition by city order by rows desc, p, split_group_id) - 1) % 3 as integer) shadow_fold
  from (select city, split_group_id, count(*) rows, cast('0x' || substr(sha256('20260810:' || split_group_id), 1, 16) as ubigint) p from fold_manifest group by 1, 2)"""


@query("f02_balanced_folds", f"select scenario_id, split_group_id, city, 'train' source_split, shadow_fold, graph_sha256 from fold_manifest join ({DEALT}) using (city, split_group_id)")
def f02(spark, d):
    return folds.dealt_folds(manifest_table(spark, d))


@query("f02b_dealt_folds", """select split_group_id, cast((row_number() over (partition by city order by rows desc, p, split_group_id) - 1) % 3 as integer)
  shadow_fold from (select city, split_group_id, count(*) rows, cast('0x' || substr(sha256('20260810:' || split_group_id), 1, 16) as ubigint) p
  from fold_manifest group by 1, 2)""")
def f02b(spark, d):
    return folds.dealt_folds(manifest_table(spark, d)).select("split_group_id", "shadow_fold").distinct()


@query("f03_fold_counts", "select cast(shadow_fold as integer) shadow_fold, count(*) scenarios, count(distinct split_group_id) groups from fold_table group by 1")
def f03(spark, d):
    return folds.fold_counts(fold_table(spark, d))


@query("f03b_city_folds", "select city, " + ", ".join(f"count(*) filter (shadow_fold = {k}) fold_{k}" for k in range(3)) + " from fold_table group by 1")
def f03b(spark, d):
    return folds.city_fold_matrix(fold_table(spark, d))


@query("f04_check_folds", """select 'fold_in_range' rule, scenario_id key, count(*) n from fold_table where city = 'city1' group by 2
  union all select 'digest_format', scenario_id, count(*) from fold_table where city = 'city2' group by 2""")
def f04(spark, d):
    bad = fold_table(spark, d).withColumns({
        "shadow_fold": F.when(F.col("city") == "city1", 7).otherwise(F.col("shadow_fold")),
        "graph_sha256": F.when(F.col("city") == "city2", "xyz").otherwise(F.col("graph_sha256"))})
    report = folds.check_folds(bad).select(*REPORT)
    return report.where("rule <> 'group_in_one_fold'")


@query("f05_effective_manifest", """select scenario_id, split_group_id, case when shadow_fold = 1 then 'val' else 'train' end split, 'train' original_split
  from fold_table""")
def f05(spark, d):
    return folds.effective_manifest(manifest_table(spark, d), fold_table(spark, d), 1).select(
        "scenario_id", "split_group_id", "split", "original_split")


INNER = """select city, split_group_id from (select *, coalesce(sum(n) over (partition by city order by o rows between unbounded preceding and 1 preceding), 0) b,
    sum(n) over (partition by city) t from (select city, split_group_id, count(*) n, sha256('20260821:' || city || ':' || split_group_id) o
      from fold_manifest join (select scenario_id from fold_table where shadow_fold <> 1) using (scenario_id) group by all))
  where (b = 0 or 2 * b + n < 0.2 * t) and b + n < t"""


@query("f06_inner_validation", INNER)
def f06(spark, d):
    m = manifest_table(spark, d)
    rest = m.join(fold_table(spark, d).where("shadow_fold <> 1").select("scenario_id"), "scenario_id", "left_semi")
    return folds.inner_validation(rest, 20260821)


@query("f07_fit_score_cover", """select 'score' part, count(*) n, count(distinct split_group_id) groups from fold_table where shadow_fold = 1
  union all select 'fit', count(*), count(distinct split_group_id) from fold_table where shadow_fold <> 1""")
def f07(spark, d):
    fit, score = folds.fit_and_score(manifest_table(spark, d), fold_table(spark, d), 1)
    both = fit.withColumn("part", F.lit("fit")).unionByName(score.withColumn("part", F.lit("score")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("split_group_id").alias("groups"))


@query("f07b_inner_split", f"""select scenario_id, split_group_id, case when i.city is null then 'train' else 'val' end split
  from fold_table f left join ({INNER}) i using (city, split_group_id) where shadow_fold <> 1""")
def f07b(spark, d):
    fit, _ = folds.fit_and_score(manifest_table(spark, d), fold_table(spark, d), 1)
    return fit.select("scenario_id", "split_group_id", "split")


@query("f08_label_ratio", f"""select cast(shadow_fold as varchar) split, {r('sum(num_risk_positive_edges) / sum(num_supervision_edges)')} label_ratio
  from fold_table join fold_manifest using (scenario_id) group by 1""")
def f08(spark, d):
    rows = fold_table(spark, d).select("scenario_id", F.col("shadow_fold").cast("string").alias("split"))
    return folds.label_ratio(rows, manifest_table(spark, d)).select("split", r6("label_ratio").alias("label_ratio"))


@query("f09_contract_counts", """select shadow_fold, recorded, coalesce(actual, 0) actual from (select cast(range as integer) shadow_fold, cast(100 as bigint) recorded from range(4)) r
  full join (select shadow_fold, count(*) actual from fold_table group by 1) a using (shadow_fold) where recorded is distinct from actual""")
def f09(spark, d):
    recorded = fold_table(spark, d).select("shadow_fold").distinct().unionByName(
        fold_table(spark, d).limit(1).select(F.lit(3).alias("shadow_fold"))).withColumn("n", F.lit(100).cast("bigint"))
    actual = fold_table(spark, d).groupBy("shadow_fold").agg(F.count("*").alias("n"))
    return folds.compare_counts(recorded, actual, ["shadow_fold"], "n").fillna(0)


@query("f10_effective_fit", """select scenario_id, 'train' original_split, case when city = 'city0' then 'val' else 'train' end split
  from fold_table where shadow_fold <> 1""")
def f10(spark, d):
    fit = fold_table(spark, d).where("shadow_fold <> 1").withColumn("split", F.when(F.col("city") == "city0", "val").otherwise("train"))
    return folds.effective_fit(manifest_table(spark, d), fit).select("scenario_id", "original_split", "split")


# Constraints on tables with seeded defects.
@query("c02_unique", "select 'unique' rule, concat_ws('|', city, content_sha1) key, count(*) n from group_meta group by city, content_sha1 having count(*) > 1")
def c02(spark, d):
    return audit.unique(fixtures.group_meta(spark, d), ["city", "content_sha1"]).select(*REPORT)


@query("c03_filled_and_whole", """select 'whole' rule, cast(o_orderkey as varchar) key, count(*) n from orders where o_totalprice <> floor(o_totalprice) group by 2
  union all select 'filled', cast(o_orderkey as varchar), count(*) from orders where o_orderstatus = 'P' group by 2""")
def c03(spark, d):
    o = fixtures.table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return audit.violations(o, ["o_orderkey"], {
        "whole": audit.whole_number(F.col("o_totalprice")), "filled": audit.not_empty(F.col("status"))}).select(*REPORT)


@query("c04_strict_boolean", """select word, case when lower(trim(word)) in ('1','true','yes') then 'true' when lower(trim(word)) in ('0','false','no')
  then 'false' else 'invalid' end value, count(*) n from (select case c_custkey % 7 when 0 then ' TRUE' when 1 then 'no' when 2 then '1' when 3 then 'maybe'
  when 4 then 'False ' when 5 then null else '0' end word from customer) group by 1, 2""")
def c04(spark, d):
    words = F.element_at(F.array(*[F.lit(w) for w in (" TRUE", "no", "1", "maybe", "False ", None, "0")]),
                         (F.col("c_custkey") % 7 + 1).cast("int"))
    return fixtures.table(spark, d, "customer").select(words.alias("word")).groupBy(
        "word", F.coalesce(strict_boolean(F.col("word")).cast("string"), F.lit("invalid")).alias("value")).agg(F.count("*").alias("n"))


@query("c05_digest_format", """select 'hex' rule, cast(c_custkey as varchar) key, count(*) n from customer
  where c_custkey % 3 = 0 group by 2""")
def c05(spark, d):
    c = fixtures.table(spark, d, "customer").withColumn("digest", F.when(
        F.col("c_custkey") % 3 == 0, F.concat(F.lit("g"), F.sha2("c_name", 256))).otherwise(F.upper(F.sha2("c_name", 256))))
    return audit.violations(c, ["c_custkey"], {"hex": audit.hex_digest(F.col("digest"))}).select(*REPORT)


@query("c06_constant_and_function", """select 'nation' rule, cast(c_custkey as varchar) key, count(*) n from customer where c_nationkey <> 3 or c_nationkey is null group by 2
  union all select 'name', cast(c_custkey as varchar), count(*) from customer where c_name <> 'Customer#' || lpad(cast(c_custkey as varchar), 9, '0') group by 2""")
def c06(spark, d):
    return audit.violations(fixtures.table(spark, d, "customer"), ["c_custkey"], {
        "nation": F.col("c_nationkey") == 3,
        "name": F.col("c_name") == F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))}).select(*REPORT)


@query("c07_one_to_one", """select 'left_unique' rule, cast(c_custkey as varchar) key, count(*) n from orders join customer on o_custkey = c_custkey group by 2 having count(*) > 1
  union all select 'covered', cast(o_custkey as varchar), count(*) from orders where o_custkey % 5 = 0 group by 2""")
def c07(spark, d):
    o = fixtures.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return audit.one_to_one(o, fixtures.table(spark, d, "customer").where("c_custkey % 5 <> 0"), ["c_custkey"]).select(*REPORT)


@query("c08_set_relations", """select 'disjoint' rule, cast(k as varchar) key, cast(1 as bigint) n from (select c_custkey k from customer intersect select o_custkey from orders)
  union all select 'same_set', cast(k as varchar), 1 from (select c_custkey k from customer except select o_custkey from orders)""")
def c08(spark, d):
    a = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = fixtures.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return audit.combine(audit.disjoint(a, b, ["k"]), audit.same_set(a, b, ["k"])).select(*REPORT)


@query("c09_constant_within", """select 'constant_within' rule, city key, count(distinct content_sha1) n from group_meta
  group by 2 having count(distinct content_sha1) > 1""")
def c09(spark, d):
    return audit.constant_within(fixtures.group_meta(spark, d), ["city"], "content_sha1").select(*REPORT)
