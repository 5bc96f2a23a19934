"""Orders and draws by keyed hashes, exact splits, bootstrap samples, areas under curves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mailwarden.operators import features, hashed, ranks, scoring, training


def python_draw(seed, *keys):
    return int(hashlib.md5("|".join([str(seed), *map(str, keys)]).encode()).hexdigest()[:15], 16)


def test_numbers_are_those_of_the_sorted_hashes(spark):
    rows = [(i, i % 3 if i % 5 else None) for i in range(3000)]
    whole = {i: n for n, (_, i) in enumerate(sorted((python_draw(9, i), str(i)) for i, _ in rows))}
    for parts in (1, 8):
        df = spark.createDataFrame(rows, "id long, g int").repartition(parts)
        assert {str(r.id): r.number for r in hashed.numbered(df, 9, ["id"]).collect()} == whole
        by_group = hashed.numbered(df, 9, ["id"], ["g"]).collect()
        for g in (None, 0, 1, 2):
            own = sorted((r.number, r.id) for r in by_group if r.g == g)
            assert [n for n, _ in own] == list(range(len(own)))
            assert [i for _, i in own] == sorted((i for i, x in rows if x == g), key=lambda i: (python_draw(9, i), i))
    assert hashed.numbered(spark.createDataFrame([], "id long"), 1, ["id"]).collect() == []


def test_split_shares_are_exact(spark):
    rows = [(i, None if i < 7 else "ab"[i % 10 == 0]) for i in range(2500)]
    parts = [training.stratified_split(spark.createDataFrame(rows, "id long, label string").repartition(n), 0.8, key="id") for n in (1, 8)]
    for fit, held in parts:
        sizes = {r.label: r["count"] for r in fit.groupBy("label").count().collect()}
        totals = {g: sum(x == g for _, x in rows) for g in (None, "a", "b")}
        assert sizes == {g: int(n * 0.8 + 0.5) for g, n in totals.items()}
        assert fit.union(held).count() == 2500
    assert sorted(r.id for r in parts[0][0].collect()) == sorted(r.id for r in parts[1][0].collect())
    copies = spark.createDataFrame([(i // 4, "a") for i in range(400)], "id long, label string")
    fit, held = training.stratified_split(copies, 0.5, key="id")
    assert not {r.id for r in fit.collect()} & {r.id for r in held.collect()}  # copies of a key stay together
    fit, held = training.stratified_split(copies.limit(0), 0.5)
    assert fit.count() == held.count() == 0


def test_merged_order(spark):
    one = spark.createDataFrame([(f"A{i}@x.org", "ham") for i in range(50)], "email string, label string")
    two = spark.createDataFrame([(f"b{i}@x.org",) for i in range(50)], "email string")
    orders = []
    for n in (1, 8):
        got = training.merge_datasets({"one": (one.repartition(n), None), "two": (two.repartition(n), "fraud")}, seed=3)
        rows = sorted(got.collect(), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(100))
        orders.append([(r.email, r.label, r.source) for r in rows])
    assert orders[0] == orders[1] and {x[2] for x in orders[0][:20]} == {"one", "two"}
    limited = features.export_features(one.withColumn("name", F.lit("A")), 2025, limit=7, shuffle_seed=5, skip_mx=True)
    assert sorted(r.position for r in limited.select("position").collect()) == list(range(7))


def test_out_of_bag_trees_saw_nothing_of_the_row(spark):
    r = random.Random(1)
    rows = [(i, i % 100 / 100, r.random(), int(i % 100 > 60)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int").cache()
    model = training.train_bagged(df, ["a", "b"], "id", trees=6, max_depth=3, min_leaf=5)
    assert scoring.validate_model(model) == []
    unit = lambda i, tree: python_draw(42, tree, i) / float(1 << 60)
    weight = lambda i, tree: sum(unit(i, tree) >= c for c in training.POISSON)
    leaves = {x.id: x.leaves for x in scoring.forest_leaves(df, model).collect()}
    right: dict = {}
    for got in training.out_of_bag(df, model, "id").collect():
        unseen = [t for t in range(6) if weight(got.id, t) == 0]
        assert got.n_trees == len(unseen)
        own = [leaves[got.id][t] for t in unseen]
        assert (got.score is None) == (not own) and (not own or got.score == pytest.approx(sum(own) / len(own)))
        for t, v in zip(unseen, own, strict=True):
            right.setdefault(t, []).append(int(v >= 0.5) == got.label)
    accuracy = {x.tree: (x.rows, round(x.accuracy, 9)) for x in training.tree_accuracy(df, model, "id").collect()}
    assert accuracy == {t: (len(v), round(sum(v) / len(v), 9)) for t, v in right.items()}
    assert all(450 < n < 650 for n, _ in accuracy.values()) and sum(a for _, a in accuracy.values()) / 6 > 0.9
    sizes = {x.tree: (x.in_bag, x.draws, x.out_of_bag) for x in training.bootstrap_sizes(df, "id", 6).collect()}
    assert sizes == {t: (sum(weight(i, t) > 0 for i, *_ in rows), sum(weight(i, t) for i, *_ in rows), sum(weight(i, t) == 0 for i, *_ in rows)) for t in range(6)}
    again = training.train_bagged(df.repartition(7), ["a", "b"], "id", trees=6, max_depth=3, min_leaf=5)
    assert [t["f"] for t in again["forest"]] == [t["f"] for t in model["forest"]]


def test_draws_are_made_once_a_tree(spark):
    leaf = lambda v: {"t": "l", "v": v}
    trees = [{"t": "n", "f": "a", "v": 0.5, "l": leaf(0.1), "r": leaf(0.9)}, leaf(0.2), leaf(0.7), leaf(0.5)]
    model = {"meta": {"version": "1", "features": ["a"], "tree_count": 4, "config": {"max_depth": 3}, "bootstrap_seed": 42}, "forest": trees}
    df = spark.range(500).select("id", (F.col("id") % 100 / 100.0).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("label"))
    bags = df.select("id", "label", F.array(*[training.bootstrap_weight(42, i, F.col("id")) for i in range(4)]).alias("w")).collect()
    judged, rated = training.out_of_bag(df, model, "id"), training.tree_accuracy(df, model, "id")
    for got in (judged, rated):
        assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 4
    assert {r.id: r.n_trees for r in judged.collect()} == {r.id: r.w.count(0) for r in bags}
    assert {r.tree: r.rows for r in rated.collect()} == {i: sum(r.w[i] == 0 for r in bags) for i in range(4)}
    known = [r for r in bags if r.w[1] == 0 and r.label is not None]
    assert {r.tree: r.accuracy for r in rated.collect()}[1] == pytest.approx(sum(r.label == 0 for r in known) / len(known))
    assert training.tree_accuracy(df.limit(0), model, "id").collect() == []


def test_digits_say_what_units_say(spark):
    rows = spark.range(4000).select(*[c for i in range(2) for c in (hashed.digits(42, F.lit(i), F.col("id")).alias(f"d{i}"), training.bootstrap_weight(42, i, F.col("id")).alias(f"w{i}"))])
    assert rows.where((training._times(F.col("d0")) != F.col("w0")) | (training._times(F.col("d1")) != F.col("w1"))).count() == 0
    for share in (0.0, 0.25, *training.POISSON):
        at = int(hashed.digits_from(share), 16)
        assert at / float(1 << 60) >= share and (at == 0 or (at - 1) / float(1 << 60) < share)


def test_roc_area(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 1) if i % 50 else None, r.randint(0, 1)) for i in range(800)] + [(0.5, None), (0.5, 7)]
    pos = [s for s, y in rows if y == 1 and s is not None]
    neg = [s for s, y in rows if y == 0 and s is not None]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    for parts in (3, 200):
        got = ranks.roc_area(spark.createDataFrame(rows, "score double, label int"), parts=parts).first()
        assert got.auc == pytest.approx(want) and (got.positives, got.negatives) == (len(pos), len(neg))
    one = ranks.roc_area(spark.createDataFrame([(0.1, 1)], "score double, label int")).first()
    assert one.auc is None and one.positives == 1


def test_random_search_is_fixed_by_its_seed(spark):
    df = spark.range(300).select("id", (F.col("id") % 100 / 100.0).alias("a"), (F.col("id") * 37 % 101 / 101).alias("b"), (F.col("id") % 100 > 60).cast("int").alias("label"))
    kw = {"draws": 3, "folds": 2, "trees": (2, 4), "depth": (2, 3), "leaf": (1, 5)}
    one, two = (training.random_search(df, ["a", "b"], at_once=n, **kw) for n in (1, 4))
    assert one == two and len(one) == 3 and one[0]["auc"] > 0.9 and one[0]["auc"] >= one[-1]["auc"]
