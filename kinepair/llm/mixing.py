"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). A budget of tokens goes down the tree by weights; a node
never gets more than its leaves hold in MAX_EPOCHS passes. What a short child cannot take
goes to its siblings, in proportion to their weights, and only what a whole family cannot
take has gone to the family's own siblings before. Within a leaf, documents
are put in an order seeded by epoch and id, epoch after epoch, and the shortest prefix that reaches the
budget is taken. A row's place comes from its id; rows without an id, and repeats, are told apart by leaf, digest of the text and a number among whole repeats.

The order is needed only in one place: hash buckets of the order are summed first, buckets wholly inside the
budget are taken and wholly outside it left, and only the bucket with the end is sorted. A
leaf with a third of all rows is therefore spread over all its buckets.

All amounts are whole numbers. Defined results: a null or wordless text has no tokens (it is taken
where its place in the order is reached, and never in a leaf without any tokens); null lang or source is the leaf name
'unknown'; rows with the same id or none have places
of their own and are taken each by itself; an empty table or a budget of 0 gives an empty result; further columns are kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinepair.llm.common import text_digest, whole_text
from kinepair.sources.staging import staged

LEVELS = ("domain", "lang", "source")
#: Weights are given per node name and level; names not listed weigh 1.
DOMAINS = {"src0": "crawl", "src1": "books", "src2": "books", "src3": "code", "src4": "code"}
OTHER_DOMAIN = "web"
WEIGHTS = {"domain": {"crawl": 2, "books": 2, "code": 1, "web": 5}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {}}
MAX_EPOCHS, SHARE_PERCENT, SEED = 2, 60, 17
BUCKETS = 4096


def _choice(column: Column, names: dict, other) -> Column:
    out = F.lit(other)
    for name, value in names.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def leaves_and_tokens(docs: DataFrame, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """The rows with their leaf and `tokens`, the number of words."""
    source = F.coalesce("source", F.lit("unknown"))
    return docs.withColumns({"_domain": _choice(source, domains, OTHER_DOMAIN), "_lang": F.coalesce("lang", F.lit("unknown")), "_source": source,
                             "_tokens": F.size(F.array_remove(F.split(whole_text(), r"[ \t\n\x0B\f\r]+"), "")).cast("long")})


def _allocate(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Fills children (cap, weight) of each parent from its `budget`: in proportion to weight, none above its cap.

    Children are ordered by cap per weight; those that fill up come first. A child fills up if its share of what those
    before it left, at the weight of those not before it, reaches its cap. What is
    left after rounding down goes in whole tokens to the first children that have room.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "cap", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = nodes.withColumns({"_cap": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                              "_weight": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    # decimal(38) keeps products of two longs exact.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    full = (wide("budget") - wide("_cap")) * wide("weight") >= wide("cap") * wide("_weight")
    marked = rest.withColumn("_full", full)
    open_cap = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(Window.partitionBy(*parent))
    open_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(Window.partitionBy(*parent))
    shared = marked.withColumns({"_left": F.col("budget") - open_cap, "_open": open_weight})
    given = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("(cast(_left as decimal(19,0)) * weight) div _open"))
    floored = shared.withColumn("given", given)
    missing = F.col("budget") - F.sum("given").over(Window.partitionBy(*parent))
    slack = F.sum(F.when(F.col("given") < F.col("cap"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    more = F.when((F.col("given") < F.col("cap")) & (slack <= missing), 1).otherwise(0)
    return floored.withColumn("given", F.col("given") + more)


def budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, supply, given) for the leaf table (domain, lang, source, supply).

    Works on aggregated leaves: three levels of sums up and three allocations down.
    """
    now = leaves.withColumn("cap", F.col("supply") * max_epochs)
    top = now.agg(F.sum("cap").alias("_all")).select(F.least(F.lit(int(budget)), F.coalesce("_all", F.lit(0))).alias("budget"))
    parents = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth + 1])
        nodes = now.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumns({"name": F.col(level), "weight": _choice(F.col(level), weights.get(level, {}), 1).cast("long")})
        nodes = nodes.crossJoin(F.broadcast(top)) if parents is None else nodes.join(parents.select(*path[:-1], F.col("given").alias("budget")), path[:-1])
        parents = _allocate(nodes.withColumn("_root", F.lit(0)), path[:-1] or ["_root"])
    return leaves.join(parents.select(*LEVELS, "given"), list(LEVELS))


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `_nth`, the number of a row among those of its leaf with equal id and digest.

    Counted within parts of the table first, so that a text repeated in a third of all rows is not numbered by one task.
    """
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "digest")
    named = rows.withColumns({"_name": name, "_part": F.shiftright("_row", 16)})
    key = [*LEVELS, "_name", "_part"]
    parts = named.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key[:-1]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.sum("_n").over(before)).where("_start > 0").drop("_n")
    within = F.row_number().over(Window.partitionBy(*key).orderBy("_row")) - 1
    return named.withColumn("_nth", within).join(starts, key, "left").withColumn("_nth", F.col("_nth") + F.coalesce("_start", F.lit(0))).drop("_name", "_part", "_start")


def _rank(epoch: Column) -> Column:
    """Seeded place of a row in an epoch of its leaf: 128 bits as text, then the digest, as texts may share an id."""
    further = F.when(F.col("doc_id").isNull() | (F.col("_nth") > 0), F.concat_ws(":", F.lit(""), "digest", F.col("_nth"))).otherwise("")
    seeded = F.concat(F.concat_ws(":", F.lit(SEED), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))), further)
    return F.concat(F.md5(seeded.cast("binary")), "digest")


def select(docs: DataFrame, budget: int | None = None, share_percent: int = SHARE_PERCENT, weights: dict[str, dict[str, int]] = WEIGHTS,
           domains: dict[str, str] = DOMAINS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document and epoch taken: doc_id, domain, lang, source, epoch, n_tokens, used_tokens.

    used_tokens is what of the document lies within the leaf's budget; it is less than n_tokens only at
    the end of the prefix. The budget is `share_percent` of all tokens if not given.
    """
    own = docs.select("doc_id", "text", "lang", "source", F.monotonically_increasing_id().alias("_row"))
    return _taken(own, budget, share_percent, weights, domains, max_epochs).drop("_row")


def _taken(docs: DataFrame, budget: int | None = None, share_percent: int = SHARE_PERCENT, weights: dict[str, dict[str, int]] = WEIGHTS,
           domains: dict[str, str] = DOMAINS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`select` with the `_row` that each row of `docs` is numbered by."""
    rows = leaves_and_tokens(docs, domains).select("_row", text_digest().alias("digest"), "doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"))
    rows = staged(_numbered(staged(rows, "mix-places")), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    if budget is None:
        budget = (leaves.agg(F.sum("supply")).first()[0] or 0) * share_percent // 100
    # Leaves are few next to documents, but their number is not bounded, so nothing is broadcast by force.
    plan = staged(budgets(leaves, budget, weights, max_epochs), "mix-plan").where("given > 0")
    passes = F.explode(F.sequence(F.lit(0), F.expr("cast((given - 1) div supply as int)"))).alias("epoch")
    wanted = plan.select(*LEVELS, passes, "supply", "given").select(*LEVELS, "epoch", F.least("supply", F.expr("given - epoch * supply")).alias("target"))
    placed = _spread(rows, wanted).withColumn("rank", _rank(F.col("epoch")))
    placed = placed.withColumn("bucket", F.conv(F.substring("rank", 1, 3), 16, 10).cast("int"))
    key = [*LEVELS, "epoch"]
    # Buckets are BUCKETS rows per leaf and epoch at most.
    sums = placed.groupBy(*key, "target", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts = staged(starts, "mix-buckets")
    whole = starts.where("start + size <= target").select(*key, "bucket", F.lit(None).cast("long").alias("room"))
    cut = starts.where("start < target and start + size > target").select(*key, "bucket", (F.col("target") - F.col("start")).alias("room"))
    found = placed.join(whole.unionByName(cut), [*key, "bucket"])
    out = ["_row", "doc_id", *LEVELS, "epoch", "n_tokens", "used_tokens"]
    inside = found.where("room is null").withColumn("used_tokens", F.col("n_tokens")).select(*out)
    prefix = Window.partitionBy(*key, "bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    edge = found.where("room is not null").withColumn("ahead", F.coalesce(F.sum("n_tokens").over(prefix), F.lit(0))).where("ahead < room")
    return inside.unionByName(edge.withColumn("used_tokens", F.least("n_tokens", F.col("room") - F.col("ahead"))).select(*out))


def _spread(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows with the epochs of their leaf, joined by leaf; one leaf may hold a third of the rows, so both sides carry a salt."""
    salts = 64
    many = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    return salted.join(many, [*LEVELS, "salt"]).drop("salt")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents taken, whole, with all their columns, once per epoch in which they are taken."""
    # Rows are numbered once and written, as ids do not tell them apart; their own columns travel apart from the number.
    rows = staged(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_all")), "mix-documents")
    wanted = rows.select("_row", *[F.col("_all")[c].alias(c) for c in ("doc_id", "text", "lang", "source")])
    times = _taken(wanted, **options).groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    return rows.join(times, "_row").withColumn("_copy", F.explode(F.expr("array_repeat(1, _times)"))).select("_all.*")
