"""What a build was made from: per scenario a tree of digests over its files, the configuration and the code.

The root digest covers three branches: files, configuration, code. Trees are compared from the root down, so leaves are looked at only in scenarios whose roots differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinepair.operators import audit

#: Kinds of source files by name, and how many of each a scenario has.
KINDS = {"frames": r"^scenario_.*\.parquet$", "map": r"^log_map_archive_.*\.json$"}
LEAF = "array<struct<leaf: string, size: bigint, sha256: string>>"


def source_files(files: DataFrame, root: str) -> DataFrame:
    """(scenario_id, relative_path, kind, size, sha256) of the files (path, size, sha256) right in the scenario folders under `root`; others are left out."""
    inside = F.col("path").startswith(root.rstrip("/") + "/")
    relative = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    name = F.element_at(F.split("relative_path", "/"), -1)
    kind = F.coalesce(*[F.when(name.rlike(pattern), k) for k, pattern in KINDS.items()])
    found = files.where(inside).withColumn("relative_path", relative).where(F.col("relative_path").contains("/")).withColumn("kind", kind)
    return found.where("kind is not null").select(F.element_at(F.split("relative_path", "/"), -2).alias("scenario_id"), "relative_path", "kind", "size", "sha256")


def check_source_files(sources: DataFrame) -> DataFrame:
    """Scenarios without exactly one file of each kind: (rule, key, n)."""
    counts = sources.groupBy("scenario_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    return audit.violations(counts, ["scenario_id"], {f"one_{k}_file": F.col(k) == 1 for k in KINDS})


def source_tree(sources: DataFrame, config_sha256: Column | str, code_sha256: Column | str) -> DataFrame:
    """scenario_id, leaves, files_sha256, config_sha256, code_sha256, source_sha256 (the root). Files of a scenario are few, and listed by path."""
    leaf = F.struct(F.col("relative_path").alias("leaf"), F.col("size").cast("bigint").alias("size"), "sha256")
    digest = lambda v: F.lit(v) if isinstance(v, str) else v
    trees = sources.groupBy("scenario_id").agg(F.array_sort(F.collect_list(leaf)).cast(LEAF).alias("leaves"))
    line = F.transform("leaves", lambda x: F.concat_ws("\t", x["leaf"], x["size"].cast("string"), x["sha256"]))
    trees = trees.withColumns({"files_sha256": F.sha2(F.array_join(line, "\n"), 256), "config_sha256": digest(config_sha256), "code_sha256": digest(code_sha256)})
    return trees.withColumn("source_sha256", F.sha2(F.concat_ws("\n", "files_sha256", "config_sha256", "code_sha256"), 256))


def changed_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scenario_id, leaf, state) of two tables of trees: leaves `changed`, `missing` in the new one, or `extra` there; the branches are `config` and `code`.

    Scenarios are joined by id with their roots; those with equal roots are dropped before any leaf is read.
    """
    side = lambda t, n: t.select("scenario_id", F.col("source_sha256").alias(f"root_{n}"), F.struct("leaves", "config_sha256", "code_sha256").alias(n))
    apart = side(old, "old").join(side(new, "new"), "scenario_id", "full").where(~F.col("root_old").eqNullSafe(F.col("root_new")))

    def listed(n: str) -> Column:
        branch = lambda k: F.struct(F.lit(k).alias("leaf"), F.lit(None).cast("bigint").alias("size"), F.col(f"{n}.{k}_sha256").alias("sha256"))
        whole = F.concat(f"{n}.leaves", F.array(branch("config"), branch("code")).cast(LEAF))
        none = F.array().cast(LEAF)
        return F.transform(F.when(F.col(n).isNull(), none).otherwise(whole), lambda x: F.struct(x["leaf"].alias("leaf"), F.struct(x["size"], x["sha256"]).alias("is"), F.lit(n).alias("side")))

    each = apart.select("scenario_id", F.explode(F.concat(listed("old"), listed("new"))).alias("x")).select("scenario_id", "x.*")
    was, now = (F.max(F.when(F.col("side") == n, F.col("is"))) for n in ("old", "new"))
    both = each.groupBy("scenario_id", "leaf").agg(was.alias("was"), now.alias("now")).where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("scenario_id", "leaf", F.when(F.col("was").isNull(), "extra").when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scenarios of the new table whose tree has no equal in the old one: those to build again."""
    return new.join(old.select("scenario_id", "source_sha256"), ["scenario_id", "source_sha256"], "left_anti").select("scenario_id")
