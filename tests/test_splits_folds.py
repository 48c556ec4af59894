"""Components, overlaps, folds: against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinepair.functions.ranks import running_before, running_totals
from kinepair.operators import folds, splits
from kinepair.operators.audit import ConstraintError, require


def roots(links):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for s, k in links:
        parent[find(("k", k))] = find(("s", s))
    groups = {}
    for s, _ in links:
        groups.setdefault(find(("s", s)), set()).add(s)
    return {s: min(g) for g in groups.values() for s in g}


def test_long_chain_hub_and_random_links(spark):
    chain = [(f"c{i:03d}", f"chain{j}") for i in range(60) for j in (i, i + 1)]
    hub = [(f"h{i:03d}", "hub") for i in range(200)]
    rng = random.Random(3)
    mixed = [(f"r{rng.randrange(120):03d}", f"x{rng.randrange(100)}") for _ in range(160)]
    links = sorted(set(chain + hub + mixed))
    got = {r.scenario_id: r.root for r in splits.connect(spark.createDataFrame(links, "scenario_id string, key string")).collect()}
    assert got == roots(links)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        start = rng.randrange(0, 400)
        rows.append((f"s{i}", f"city{i % 2}", float(start), float(start + rng.randrange(0, 30)), rng.choice(["train", "val"])))
    df = spark.createDataFrame(rows, "scenario_id string, city string, start_timestamp double, end_timestamp double, split string")
    got = {r.city: (r.overlap_pairs, r.cross_split_pairs) for r in splits.temporal_overlaps(df, slices=8).collect()}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]:
                n, c = want.get(a[1], (0, 0))
                want[a[1]] = (n + 1, c + (a[4] != b[4]))
    assert got == want


def test_running_totals_are_exact_for_any_slices(spark):
    rng = random.Random(2)
    rows = {(rng.choice("ab"), rng.randrange(50) / 7): rng.randrange(5) for _ in range(120)}
    df = spark.createDataFrame([(g, o, v) for (g, o), v in rows.items()], "g string, o double, v int")
    for slices in (2, 5, 64):
        for r in running_totals(df, ["g"], "o", ["v"], slices=slices).collect():
            assert r.v_total == sum(v for (g, o), v in rows.items() if g == r.g and o <= r.o)
            assert r.v_all == sum(v for (g, _), v in rows.items() if g == r.g)
    names = spark.createDataFrame([(n,) for n in ("a", "ab", "abc", "abcd", "abce", "b", "zz")], "n string").withColumn("g", F.lit(1))
    got = {r.n: r.out for r in running_before(names, ["g"], "n", F.lit(1), "out", prefix=2).collect()}
    assert got == {"a": 0, "ab": 1, "abc": 2, "abcd": 3, "abce": 4, "b": 5, "zz": 6}


def manifest(spark, groups=40):
    rng = random.Random(4)
    rows = []
    for g in range(groups):
        for k in range(rng.randrange(1, 6)):
            rows.append((f"s{g:02d}_{k}", f"g{g:02d}", f"city{g % 3}", "train", "built", "p", "a" * 64))
    return spark.createDataFrame(rows, "scenario_id string, split_group_id string, city string, split string, status string,"
                                       " graph_path string, graph_sha256 string")


def test_dealt_folds_are_balanced(spark):
    m = manifest(spark)
    f = folds.dealt_folds(m)
    assert f.count() == m.count()
    for r in folds.city_fold_matrix(f).collect():
        assert max(r.fold_0, r.fold_1, r.fold_2) - min(r.fold_0, r.fold_1, r.fold_2) <= 5
    require(folds.check_folds(f))


def test_inner_validation_is_a_prefix_near_the_target(spark):
    m = manifest(spark)
    taken = {(r.city, r.split_group_id) for r in folds.inner_validation(m, 5, 0.2).collect()}
    sizes = {(r.city, r.split_group_id): r.n for r in m.groupBy("city", "split_group_id").agg(F.count("*").alias("n")).collect()}
    order = lambda k: hashlib.sha256(f"5:{k[0]}:{k[1]}".encode()).hexdigest()
    for city in {c for c, _ in sizes}:
        mine = sorted((k for k in sizes if k[0] == city), key=order)
        chosen = [k for k in mine if k in taken]
        assert chosen == mine[:len(chosen)] and 0 < len(chosen) < len(mine)
        target, got = 0.2 * sum(sizes[k] for k in mine), sum(sizes[k] for k in chosen)
        assert abs(got - target) <= max(sizes[k] for k in mine) / 2 or len(chosen) == 1
    with pytest.raises(ConstraintError):
        folds.inner_validation(m.limit(1), 5)


def test_fit_and_score_are_disjoint_and_cover(spark):
    m = manifest(spark)
    f = folds.dealt_folds(m)
    fit, score = folds.fit_and_score(m, f, 0)
    require(folds.check_fit_and_score(fit, score, f))
    inner = fit.where("split = 'val'").count() / fit.count()
    assert 0 < inner < 0.35
    with pytest.raises(ConstraintError):
        require(folds.check_fit_and_score(fit, fit, f))


def test_split_is_stable_and_whole(spark):
    m = manifest(spark).select("scenario_id", "city", "split_group_id")
    a = splits.assign_splits(m, 7)
    b = splits.assign_splits(m.repartition(3), 7)
    assert a.exceptAll(b).count() == 0
    assert a.groupBy("split_group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(m, 7, 0.5, 0.2, 0.2)
