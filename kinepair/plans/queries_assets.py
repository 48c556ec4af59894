"""Queries over manifests, digests and run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinepair.operators import isolation, manifest, metrics, rules, tracks
from kinepair.plans import fixtures
from kinepair.plans.catalogue import query
from kinepair.plans.oracle_views import VIEWS
from kinepair.sources import assets, lineage, tables


@query("s02_one_file_rule", """select scenario_id, count(distinct track_id like '%7') files from frames group by 1 having count(distinct track_id like '%7') <> 1""")
def s02(spark, d):
    f = fixtures.frames(spark, d).withColumn("source_file", F.col("track_id").like("%7").cast("string"))
    return tables.check_one_file(f)


VIEWS["raw_manifest"] = """select scenario_id, city, case r % 4 when 0 then 'built' when 1 then 'exists' when 2 then 'skipped' else 'error' end status,
  case when r % 8 <> 1 then 'g/' || scenario_id end graph_path, case when r % 5 = 0 then 'other' else 'train' end split,
  case when r % 9 = 0 then 'bad' else sha256(scenario_id) end graph_sha256 from (select distinct scenario_id, city, r from av_frames)"""


def raw_manifest(spark, d):
    r = F.col("r")
    m = fixtures.av_frames(spark, d).select("scenario_id", "city", "r").distinct()
    return m.select(
        "scenario_id", "city", F.element_at(F.array(*[F.lit(s) for s in ("built", "exists", "skipped", "error")]), (r % 4 + 1).cast("int")).alias("status"),
        F.when(r % 8 != 1, F.concat(F.lit("g/"), "scenario_id")).alias("graph_path"),
        F.when(r % 5 == 0, "other").otherwise("train").alias("split"),
        F.when(r % 9 == 0, "bad").otherwise(F.sha2("scenario_id", 256)).alias("graph_sha256"))


@query("s06_manifest_filter", "select * from raw_manifest where status in ('built', 'exists') and graph_path is not null and split in ('train', 'val', 'test')")
def s06(spark, d):
    return manifest.usable_rows(raw_manifest(spark, d))


@query("s06b_manifest_rules", """select 'split' rule, scenario_id key, cast(1 as bigint) n from raw_manifest where status in ('built', 'exists') and graph_path is not null and split = 'other'
  union all select 'digest', scenario_id, 1 from raw_manifest where status in ('built', 'exists') and graph_path is not null and graph_sha256 = 'bad'""")
def s06b(spark, d):
    return manifest.check_manifest(raw_manifest(spark, d)).select("rule", "key", "n")


VIEWS["inputs"] = "select scenario_id, 'c1' config_sha256, sha256(scenario_id) source_sha256 from group_meta"
VIEWS["outputs"] = """select scenario_id, case when city = 'city1' then 'c0' else 'c1' end config_sha256,
  case when city = 'city2' then 'stale' else sha256(scenario_id) end source_sha256 from group_meta where city <> 'city3'"""


def builds(spark, d):
    """Requested and existing builds: one city stale by configuration, one by source, one missing."""
    m = fixtures.group_meta(spark, d).select("scenario_id", "city", F.lit("c1").alias("config_sha256"), F.sha2("scenario_id", 256).alias("source_sha256"))
    old = m.where("city <> 'city3'").withColumns({
        "config_sha256": F.when(F.col("city") == "city1", "c0").otherwise("c1"),
        "source_sha256": F.when(F.col("city") == "city2", "stale").otherwise(F.col("source_sha256"))})
    return m.drop("city"), old.drop("city")


@query("s11_incremental_anti", """select i.* from inputs i where not exists (select 1 from outputs o where o.scenario_id = i.scenario_id
  and o.config_sha256 = i.config_sha256 and o.source_sha256 = i.source_sha256)""")
def s11(spark, d):
    return manifest.pending(*builds(spark, d))


@query("s11b_incompatible", """select i.scenario_id, o.config_sha256 built_config_sha256, o.source_sha256 built_source_sha256 from inputs i join outputs o using (scenario_id)
  where o.config_sha256 <> i.config_sha256 or o.source_sha256 <> i.source_sha256""")
def s11b(spark, d):
    return manifest.incompatible(*builds(spark, d)).select("scenario_id", "built_config_sha256", "built_source_sha256")


VIEWS["digest_text"] = """select case when c_custkey % 10 = 0 then 'broken ' || c_name else sha256(c_name) || '  files/' || cast(c_custkey % 1000 as varchar) end line from customer"""


def digest_text(spark, d):
    c = fixtures.table(spark, d, "customer")
    return c.select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("broken "), "c_name")).otherwise(
        F.concat(F.sha2("c_name", 256), F.lit("  files/"), (F.col("c_custkey") % 1000).cast("string"))).alias("value"))


@query("s13_digest_parse", """select line, case when regexp_matches(line, '^[0-9a-f]{64}  ') then substr(line, 1, 64) end sha256,
  case when regexp_matches(line, '^[0-9a-f]{64}  ') then substr(line, 67) end path from digest_text""")
def s13(spark, d):
    return assets.parse_digest_lines(digest_text(spark, d))


@query("s13b_digest_rules", """select 'malformed' rule, line key, count(*) n from digest_text where line like 'broken%' group by 2
  union all select 'duplicate_path', substr(line, 67), count(*) from digest_text where line not like 'broken%' group by 2 having count(*) > 1""")
def s13b(spark, d):
    return assets.check_digest_lines(assets.parse_digest_lines(digest_text(spark, d)))


@query("s14_asset_verify", """select path, state, count(*) n from (select coalesce(a.path, b.path) path, case when b.path is null then 'missing' when a.path is null then 'extra'
  when a.h = b.h then 'ok' else 'changed' end state from (select 'f' || c_custkey path, sha256(c_name) h from customer where c_custkey % 7 <> 0) a
  full join (select 'f' || c_custkey path, case when c_custkey % 3 = 0 then 'x' else sha256(c_name) end h from customer where c_custkey % 5 <> 0) b on a.path = b.path) group by 1, 2""")
def s14(spark, d):
    c = fixtures.table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), F.sha2("c_name", 256).alias("sha256"), "c_custkey")
    actual = c.where("c_custkey % 5 <> 0").withColumn("sha256", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("sha256")))
    return assets.verify_assets(c.where("c_custkey % 7 <> 0"), actual).groupBy("path", "state").agg(F.count("*").alias("n"))


@query("s15_digest_lines", "select sha256(c_name) || '  f' || c_custkey \"value\" from customer")
def s15(spark, d):
    c = fixtures.table(spark, d, "customer").select(F.sha2("c_name", 256).alias("sha256"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"))
    return assets.digest_lines(c)


@query("s18_asset_closure", """select distinct path from (select 'm/' || city path from group_meta union all select 'r/' || recording_group_id_v2 from group_meta
  union all select 'c/' || scenario_id from group_meta union all select 'k/' || city || '.meta' from group_meta)""")
def s18(spark, d):
    doc = F.to_json(F.struct(
        F.concat(F.lit("m/"), "city").alias("source_manifest_path"),
        F.array(F.struct(
            F.concat(F.lit("r/"), "recording_group_id_v2").alias("result_path"), F.concat(F.lit("c/"), "scenario_id").alias("checkpoint_path"),
            F.struct(F.struct(F.concat(F.lit("k/"), F.col("city"), F.lit(".meta")).alias("metadata_path")).alias("source_archive")).alias("strict_crossfit_release"),
        )).alias("surrogates")))
    return assets.asset_closure(fixtures.group_meta(spark, d).select(doc.alias("metadata_json")))


@query("e18_run_records", """select scenario_id, concat_ws(',', case when length(scenario_id) > 5 then 'epochs' end,
  case when city = 'city1' then 'objective' end, case when city = 'city2' then 'threshold' end) violations from group_meta""")
def e18(spark, d):
    c, none = F.col, F.lit(None).cast("int")
    one = F.lit(1)
    stats = F.struct(one.alias("graphs_considered"), one.alias("graph_sha256_verified"), F.lit(0).alias("poisoned_graphs"))
    rec = fixtures.group_meta(spark, d).select(
        "scenario_id",
        F.struct(F.when(F.length("scenario_id") > 5, 49).otherwise(50).alias("epochs"), F.lit("val_loss").alias("checkpoint_metric"),
                 F.lit(True).alias("require_strict_label"), F.lit(False).alias("evaluate_test"), none.alias("max_train_graphs"), none.alias("max_val_graphs")).alias("config"),
        F.struct(F.when(c("city") == "city1", "other").otherwise("ordinary_binary_cross_entropy_symmetric_pair_labels").alias("objective"),
                 F.lit("random").alias("initialization")).alias("training_protocol"),
        stats.alias("train_stats"), stats.alias("val_stats"), F.struct(one.alias("train"), one.alias("val")).alias("split_graph_counts"),
        F.struct(F.lit(0.1).alias("train"), F.lit(0.2).alias("val")).alias("losses"),
        F.struct(F.when(c("city") == "city2", 1.5).otherwise(0.4).alias("threshold")).alias("val_pair_metrics"))
    out = metrics.run_record_violations(rec, metrics.training_protocol_rules(), "scenario_id")
    return out.select("scenario_id", F.array_join("violations", ",").alias("violations"))


# One seeded defect per scenario: which of the rules it breaks comes from its name.
_NUMBERED = "select scenario_id, cast('0x' || substr(md5(scenario_id), 1, 4) as integer) % {n} k from group_meta"


def _numbered(spark, d, n):
    number = F.conv(F.substring(F.md5(F.col("scenario_id").cast("binary")), 1, 4), 16, 10).cast("int") % n
    return fixtures.group_meta(spark, d).select("scenario_id", number.alias("k"))


def _unless(k, good, bad):
    return F.when(F.col("k") == k, bad).otherwise(good)


_E18B = [("config", "epochs", "50", "49"), ("config", "checkpoint_metric", "val_loss", "auc"), ("config", "require_strict_label", "true", "false"), ("config", "evaluate_test", "false", "true"),
         ("config", "uncapped", None, "7"), ("training_protocol", "objective", "ordinary_binary_cross_entropy_symmetric_pair_labels", "other"), ("training_protocol", "initialization", "random", "loaded"),
         ("train_stats", "complete", "9", "8"), ("train_stats", "verified", "9", "8"), ("val_stats", "complete", "3", "2"), ("val_stats", "unchanged", "0", "1"),
         ("val_pair_metrics", "threshold", "between 0 and 1", "1.5")]


def _cells(rows):
    quoted = lambda v: "null" if v is None else "'" + v + "'"
    return "select * from (values " + ", ".join(f"({k}, {', '.join(map(quoted, r))})" for k, r in enumerate(rows)) + ") v(k, section, rule, expected, found)"


@query("e18b_rule_table", "select scenario_id key, section, rule, expected, found from places join cells using (k)",
       {"places": _NUMBERED.format(n=len(_E18B)), "cells": _cells(_E18B)})
def e18b(spark, d):
    none = F.lit(None).cast("int")
    nine, three = F.lit(9), F.lit(3)
    rec = _numbered(spark, d, len(_E18B)).select(
        "scenario_id",
        F.struct(_unless(0, F.lit(50), F.lit(49)).alias("epochs"), _unless(1, F.lit("val_loss"), F.lit("auc")).alias("checkpoint_metric"), _unless(2, F.lit(True), F.lit(False)).alias("require_strict_label"),
                 _unless(3, F.lit(False), F.lit(True)).alias("evaluate_test"), none.alias("max_train_graphs"), _unless(4, none, F.lit(7)).alias("max_val_graphs")).alias("config"),
        F.struct(_unless(5, F.lit("ordinary_binary_cross_entropy_symmetric_pair_labels"), F.lit("other")).alias("objective"), _unless(6, F.lit("random"), F.lit("loaded")).alias("initialization")).alias("training_protocol"),
        F.struct(_unless(7, nine, F.lit(8)).alias("graphs_considered"), F.when(F.col("k").isin(7, 8), 8).otherwise(9).alias("graph_sha256_verified")).alias("train_stats"),
        F.struct(_unless(9, three, F.lit(2)).alias("graphs_considered"), _unless(10, F.lit(0), F.lit(1)).alias("poisoned_graphs")).alias("val_stats"),
        F.struct(nine.alias("train"), three.alias("val")).alias("split_graph_counts"), F.struct(_unless(11, F.lit(0.4), F.lit(1.5)).alias("threshold")).alias("val_pair_metrics"))
    return rules.broken(rec, rules.TRAINING, "scenario_id")


_P09 = [("contract", "formal_split_eligible", "true", "false"), ("contract", "metadata_contract_version", "4", "3"), ("fingerprint", "segment_frames", "3", "2"), ("fingerprint", "stride_frames", "1", "5"),
        ("fingerprint", "absolute_time_grid", "true", "false"), ("fingerprint", "coverage", "every_consecutive_three_frame_segment", "sampled")]


@query("p09_metadata_contract", """select scenario_id key, section, rule, expected, found from places join cells using (k)
  union all select scenario_id, 'output', 'rows', '1', '2' from places where k = 6 union all select scenario_id, 'output', 'digest', 'table', 'record' from places where k = 7""",
       {"places": _NUMBERED.format(n=8), "cells": _cells(_P09)})
def p09(spark, d):
    meta = fixtures.group_meta(spark, d)
    facts = rules.with_digest(meta, sorted(c for c in meta.columns if c != "scenario_id"), ["scenario_id"])
    rec = _numbered(spark, d, 8).join(facts, "scenario_id").select(
        "scenario_id", "actual_rows", "actual_digest", _unless(0, F.lit(True), F.lit(False)).alias("formal_split_eligible"), _unless(1, F.lit(4), F.lit(3)).alias("metadata_contract_version"),
        F.struct(_unless(2, F.lit(3), F.lit(2)).alias("segment_frames"), _unless(3, F.lit(1), F.lit(5)).alias("stride_frames"), _unless(4, F.lit(True), F.lit(False)).alias("absolute_time_grid"),
                 _unless(5, F.lit("every_consecutive_three_frame_segment"), F.lit("sampled")).alias("coverage")).alias("fingerprint_definition"),
        _unless(6, F.col("actual_rows"), F.col("actual_rows") + 1).alias("recorded_rows"), _unless(7, F.col("actual_digest"), F.reverse("actual_digest")).alias("recorded_digest"))
    out = rules.broken(rec, rules.METADATA, "scenario_id")
    digest = F.col("rule") == "digest"
    return out.withColumns({"expected": F.when(digest, "table").otherwise(F.col("expected")), "found": F.when(digest, "record").otherwise(F.col("found"))})



VIEWS["old_sources"] = """select scenario_id, city || '/' || scenario_id || '/' || f relative_path, cast(length(scenario_id) as bigint) size, sha256(scenario_id || f) sha256,
  'c1' config, city from group_meta, (values ('scenario_x.parquet'), ('log_map_archive_x.json')) v(f)"""
VIEWS["new_sources"] = """select scenario_id, relative_path, size, case when city = 'city1' and relative_path like '%.json' then sha256('other') else sha256 end sha256,
  case when city = 'city2' then 'c2' else config end config, city from old_sources where city <> 'city3' or relative_path not like '%.json'"""
_TREE = """select scenario_id, sha256(sha256(string_agg(relative_path || chr(9) || size || chr(9) || sha256, chr(10) order by relative_path)) || chr(10) || min(config) || chr(10) || 'k1') source_sha256
  from old_sources group by 1"""


def source_trees(spark, d):
    """Trees of two builds: in the later one a map of one city differs, another city has a further configuration, a third has lost its maps."""
    m = fixtures.group_meta(spark, d).select("scenario_id", "city")
    names = F.explode(F.array(F.lit("scenario_x.parquet"), F.lit("log_map_archive_x.json"))).alias("f")
    files = m.select("scenario_id", "city", names).select(
        F.concat_ws("/", F.lit("/r"), "city", "scenario_id", "f").alias("path"), F.length("scenario_id").alias("size"), F.sha2(F.concat("scenario_id", "f"), 256).alias("sha256"), "city")
    maps = F.col("path").endswith(".json")
    later = files.where((F.col("city") != "city3") | ~maps).withColumn("sha256", F.when((F.col("city") == "city1") & maps, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")))
    config = F.when(F.split(F.col("leaves")[0]["leaf"], "/")[0] == "city2", "c2").otherwise("c1")
    return (lineage.source_tree(lineage.source_files(files, "/r"), "c1", "k1"), lineage.source_tree(lineage.source_files(later, "/r"), config, "k1"))


@query("g11_source_tree", _TREE)
def g11_tree(spark, d):
    return source_trees(spark, d)[0].select("scenario_id", "source_sha256")


@query("g11b_changed_leaves", """select scenario_id, o.relative_path leaf, case when n.scenario_id is null then 'missing' else 'changed' end state
  from old_sources o left join new_sources n using (scenario_id, relative_path) where n.sha256 is distinct from o.sha256
  union all select distinct scenario_id, 'config', 'changed' from new_sources where config <> 'c1'""")
def g11_changed(spark, d):
    return lineage.changed_leaves(*source_trees(spark, d))


VIEWS["bad_frames"] = """select scenario_id, case when sc % 9 = 5 and k % 12 = 1 then 'other' else city end city,
  case when sc % 9 = 3 and k % 12 = 3 and timestep % 20 = 7 then null else track_id end track_id, case when sc % 9 = 4 and k % 12 = 5 and timestep % 50 = 9 then timestep + 200 else timestep end timestep,
  case when sc % 9 = 1 and k % 12 = 0 then null else position_x end position_x, position_y
  from (select *, k // 12 sc from (select *, cast(substr(track_id, 2) as bigint) k from frames)) where not (sc % 9 = 2 and timestep >= 45)"""
VIEWS["map_texts"] = """select scenario_id, case when sc % 8 = 6 then left(doc, length(doc) - 1) when sc % 8 = 7 then '{"lane_segments":{}}' else doc end map_json
  from (select *, '{"lane_segments":{"' || sc || '":{"id":' || sc || '}}}' doc from (select distinct scenario_id, cast(substr(scenario_id, 2) as bigint) sc from frames))"""
VIEWS["faults"] = """with t as (select scenario_id, track_id, count(*) filter (track_id is null or timestep is null) u, count(*) filter (timestep not between 0 and 109) o,
    count(*) filter (position_x is not null and position_y is not null) p, max(timestep) l, min(city) lo, max(city) hi from bad_frames group by all),
  s as (select scenario_id, sum(u) u, sum(o) o, count(*) filter (p = 0 and track_id is not null) n, min(track_id) filter (p = 0) f, max(l) l, min(lo) lo, max(hi) hi from t group by 1)
  select scenario_id, 'map' stage, 'unreadable_map' reason, length(map_json) || ' characters' detail from map_texts where not json_valid(map_json)
  union all select scenario_id, 'map', 'map_without_lanes', 'lane_segments' from map_texts where json_valid(map_json) and map_json like '%{}}'
  union all select scenario_id, 'frames', 'rows_without_key', cast(cast(u as bigint) as varchar) from s where u > 0
  union all select scenario_id, 'frames', 'steps_off_grid', cast(cast(o as bigint) as varchar) from s where o > 0
  union all select scenario_id, 'frames', 'track_without_positions', n || ' from ' || f from s where n > 0
  union all select scenario_id, 'frames', 'short_recording', cast(l as varchar) from s where l < 50
  union all select scenario_id, 'frames', 'several_cities', lo || ' ' || hi from s where lo <> hi"""


def damaged_scenarios(spark, d):
    """Frames and map documents of which some scenarios cannot be built, each in its own way."""
    sc, i, t = F.floor(F.col("k") / 12), F.col("k") % 12, F.col("timestep")
    hit = lambda n, more, value, name: F.when((sc % 9 == n) & more, value).otherwise(F.col(name))
    frames = fixtures.frames(spark, d).where(~((sc % 9 == 2) & (t >= 45))).withColumns({
        "city": hit(5, i == 1, F.lit("other"), "city"), "track_id": hit(3, (i == 3) & (t % 20 == 7), F.lit(None), "track_id"),
        "timestep": hit(4, (i == 5) & (t % 50 == 9), t + 200, "timestep"), "position_x": hit(1, i == 0, F.lit(None), "position_x")})
    n, doc = F.col("n"), F.concat(F.lit('{"lane_segments":{"'), "n", F.lit('":{"id":'), "n", F.lit("}}}"))
    named = fixtures.frames(spark, d).select("scenario_id", F.substring("scenario_id", 2, 20).cast("bigint").alias("n")).distinct()
    maps = named.withColumn("doc", doc).select(
        "scenario_id", F.when(n % 8 == 6, F.expr("left(doc, length(doc) - 1)")).when(n % 8 == 7, F.lit('{"lane_segments":{}}')).otherwise(F.col("doc")).alias("map_json"))
    return frames, maps


@query("s16_scenario_faults", "select * from faults")
def s16(spark, d):
    return isolation.validated(*damaged_scenarios(spark, d))


@query("s16b_isolated_build", """select scenario_id, 'error' status, arg_min(reason, (stage = 'frames', reason, detail)) reason, count(*) num_faults, cast(null as bigint) num_nodes from faults group by 1
  union all select scenario_id, case when count(*) < 2 then 'skipped' else 'built' end, case when count(*) < 2 then 'fewer_than_two_nodes' end, null, count(*)
  from kept where scenario_id not in (select scenario_id from faults) group by 1""")
def s16b(spark, d):
    frames, maps = damaged_scenarios(spark, d)
    faults = isolation.validated(frames, maps)
    nodes = tracks.build_nodes(isolation.admitted(frames, faults)).groupBy("scenario_id").agg(F.count("*").alias("num_nodes"))
    few = F.col("num_nodes") < 2
    built = nodes.select("scenario_id", F.when(few, "skipped").otherwise("built").alias("status"), F.when(few, "fewer_than_two_nodes").alias("reason"), "num_nodes")
    return isolation.outcome(built, faults)[0].select("scenario_id", "status", "reason", "num_faults", "num_nodes")
