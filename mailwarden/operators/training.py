"""Training samples, forests, calibration, thresholds and evaluation."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
from collections.abc import Callable
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import io
from .hashed import digits, digits_from, draw, kth_least, numbered, unit
from .ranks import at_rank, interpolated, roc_area, running_counts
from .scoring import apply_platt, forest_leaves, forest_score, validate_model

T = TypeVar("T")

# Least recall, most false positives, most false negatives, least gap between the thresholds.
PRESETS = {"in_process": (0.88, 0.10, 0.12, 0.05), "cli": (0.95, 0.05, 0.05, 0.01)}
MODEL_BYTES = 25 * 1024 * 1024


# ---- samples ----


def auto_label(is_disposable: Column, is_free: Column, score: Column, decision: Column) -> Column:
    """Label and label_source of a scored sign-up."""
    known = F.coalesce(is_free.cast("boolean") & (score < 0.2), F.lit(False))
    disposable = F.coalesce(is_disposable.cast("boolean"), F.lit(False))
    by_model = F.when(decision == "block", 1).when(decision == "allow", 0).otherwise((score >= 0.5).cast("int"))
    return F.struct(F.when(disposable, 1).when(known, 0).otherwise(by_model).alias("label"), F.when(disposable, "known_disposable").when(known, "known_provider").otherwise("model").alias("label_source"))


def upsert_samples(old: DataFrame, new: DataFrame, preserve_manual: bool = False) -> DataFrame:
    """One row for each email_hash, the newest; of equal times the new table's. With preserve_manual a manual label outlives newer rows of the model."""
    both = old.withColumn("from_new", F.lit(0)).unionByName(new.withColumn("from_new", F.lit(1)), allowMissingColumns=True)
    first = [F.desc((F.col("label_source") == "manual").cast("int"))] if preserve_manual else []
    order = W.partitionBy("email_hash").orderBy(*first, F.desc("timestamp"), F.desc("from_new"), F.desc("label"))
    return both.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "from_new")


def correct_labels(samples: DataFrame, corrections: DataFrame, now: dt.datetime) -> DataFrame:
    """Samples with the labels of corrections (email_hash, label): source manual, time now. Unknown hashes come in with an empty vector; of several corrections of one hash the greatest label counts."""
    c = corrections.groupBy("email_hash").agg(F.max("label").alias("new_label"))
    both = samples.join(c, "email_hash", "full_outer")
    fixed = F.col("new_label").isNotNull()
    values = {
        "label": F.coalesce(F.col("new_label"), F.col("label")), "label_source": F.when(fixed, "manual").otherwise(F.col("label_source")),
        "timestamp": F.when(fixed, F.lit(now)).otherwise(F.col("timestamp")), "feature_vector": F.coalesce(F.col("feature_vector"), F.lit("{}"))}
    return both.select(*[values[x].cast(samples.schema[x].dataType).alias(x) if x in values else F.col(x) for x in samples.columns])


def prune(df: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    """T4: rows of the last `days` (14 for samples, 30 for the log)."""
    return df.where(F.col("timestamp") >= F.lit(as_of - dt.timedelta(days=days)))


def conflict_weight(bigram_entropy: Column, reputation: Column, weight: float = 20.0) -> Column:
    """T5: 20 for rows of high entropy on doubtful domains, else 1."""
    return F.when(conflict(bigram_entropy, reputation), float(weight)).otherwise(1.0)


def conflict(bigram_entropy: Column, reputation: Column) -> Column:
    return F.coalesce((bigram_entropy > 3.0) & (reputation >= 0.6), F.lit(False))


def stratified_split(df: DataFrame, share: float = 0.8, seed: int = 42, label: str = "label", key: str | None = None, write_cuts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two parts; of each label's n rows the first has exactly round(share * n), those of least hash of their key.

    A label's cut is the hash at that rank, so no rows are sorted or moved. Rows that share a key and a label stay together (then
    the shares are exact but for them). Without a key all columns are one. With write_cuts the cuts, a row for each label, are found
    now and written to the shared folder: parts that are read many times don't have the search, dozens of stages, in each
    plan, and Spark knows how small the cuts are before it moves the rows to them.
    """
    keys = F.col(key).cast("string") if key else F.to_json(F.struct(*df.columns))
    rows = df.withColumns({"_draw": draw(seed, keys), "_key": F.coalesce(keys, F.lit(""))})
    narrow = rows.select(F.col(label).alias("g"), F.col("_draw").alias("d"), F.col("_key").alias("k"))
    ranks = narrow.groupBy("g").agg(F.floor(F.count("*") * share + 0.5).alias("rank"))
    cuts = kth_least(narrow, ranks.where("rank > 0")).select(F.col("g").alias("_cut_g"), F.struct(F.col("d"), F.col("k")).alias("_cut"))
    cuts = io.written(cuts, "cuts") if write_cuts else cuts
    found = rows.join(cuts, rows[label].eqNullSafe(cuts["_cut_g"]), "left")
    inside = F.coalesce(F.struct(F.col("_draw").alias("d"), F.col("_key").alias("k")) <= F.col("_cut"), F.lit(False))
    return found.where(inside).select(*df.columns), found.where(~inside).select(*df.columns)


# ---- models ----


def _tree_json(node, names: list[str]) -> dict:
    """A tree of Spark's in compact JSON. Its split is `feature <= threshold` to the left."""
    if node.numDescendants() == 0:
        raw = list(node.impurityStats().stats())
        return {"t": "l", "v": round(float(raw[1] / sum(raw)) if len(raw) > 1 and sum(raw) else 0.0, 6)}
    split = node.split()
    return {"t": "n", "f": names[split.featureIndex()], "v": float(split.threshold()), "l": _tree_json(node.leftChild(), names), "r": _tree_json(node.rightChild(), names)}


def _assembled(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)


def train_forest(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, trees: int = 10, max_depth: int = 6, min_leaf: int = 20, seed: int = 42, conflict_weight_by: float | None = 20.0) -> dict:
    """A weighted forest in F4's JSON form. Conflict rows weigh more where the frame has their two features; other weights multiply in."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if conflict_weight_by and {"bigram_entropy", "domain_reputation_score"} <= set(df.columns):
        w = w * conflict_weight(F.col("bigram_entropy"), F.col("domain_reputation_score"), conflict_weight_by)
    data = _assembled(df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"), w.alias("weight")), features)
    model = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, impurity="gini", featureSubsetStrategy="sqrt", weightCol="weight", seed=seed).fit(data)
    total = float(sum(model.featureImportances)) or 1.0
    return {
        "meta": {"version": "1", "features": features, "tree_count": trees, "config": {"max_depth": max_depth, "min_leaf": min_leaf, "n_trees": trees},
                 "feature_importance": {f: round(float(model.featureImportances[i]) / total, 6) for i, f in enumerate(features)}},
        "forest": [_tree_json(t._call_java("rootNode"), features) for t in model.trees]}


def train_tree(df: DataFrame, features: list[str], label: str = "label", max_depth: int = 6, min_leaf: int = 50, seed: int = 42) -> dict:
    """One tree in compact JSON, a reason at each leaf."""
    data = _assembled(df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label")), features)
    root = _tree_json(DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, impurity="gini", seed=seed).fit(data)._call_java("rootNode"), features)

    def reasons(n: dict, last: str) -> dict:
        if n["t"] == "l":
            return {**n, "reason": last}
        return {**n, "l": reasons(n["l"], f"{n['f']}<={n['v']:g}"), "r": reasons(n["r"], f"{n['f']}>{n['v']:g}")}

    return reasons(root, "root")


def out_of_fold_scores(df: DataFrame, features: list[str], key: str, label: str = "label", folds: int = 5, seed: int = 42, **options) -> DataFrame:
    """Key, label, score and correct (at 0.5) of each row, from a forest that didn't see it."""
    parts = df.withColumn("_fold", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(folds)))
    out = None
    for i in range(folds):
        model = train_forest(parts.where(F.col("_fold") != i), features, label, seed=seed, **options)
        got = forest_score(parts.where(F.col("_fold") == i), model, 0).select(key, F.col(label).alias("label"), "score")
        out = got if out is None else out.union(got)
    return out.withColumn("correct", ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int"))


#: Distribution function of the Poisson distribution of mean 1, at 0 to 9.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10))


def bootstrap_weight(seed: int, tree: int, key: Column) -> Column:
    """How often a row is in a tree's bootstrap sample: a Poisson draw of mean 1 from a hash of seed, tree and key."""
    u = unit(seed, F.lit(tree), key)
    out = F.lit(0)
    for c in POISSON:
        out = out + (u >= c).cast("int")
    return out


def _times(drawn: Column) -> Column:
    """bootstrap_weight from a column that has the digits of its draw. Most rows are settled by the first comparisons."""
    out = F.when(drawn < digits_from(POISSON[0]), 0)
    for k, c in enumerate(POISSON[1:], 1):
        out = out.when(drawn < digits_from(c), k)
    return out.otherwise(len(POISSON))


def side_by_side(spark: SparkSession, tasks: list[Callable[[], T]], at_once: int) -> list[T]:
    """Results of independent Spark jobs in the order of the tasks, so many of which run at a time."""
    with ThreadPool(max(1, min(at_once, len(tasks)))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(task) for task in tasks])


def train_bagged(df: DataFrame, features: list[str], key: str, label: str = "label", weight: str | None = None, trees: int = 10, max_depth: int = 6, min_leaf: int = 20, seed: int = 42, at_once: int = 4) -> dict:
    """A forest in F4's JSON form whose trees' samples are known: tree i has each row bootstrap_weight(seed, i, key) times.

    A weight is a function of the row's key, so samples agree however often rows are read, and out_of_bag can tell who saw whom.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"), F.col(key).cast("string").alias("_key"), w.alias("_weight"))
    drawn = rows.withColumns({f"_digits_{i}": digits(seed, F.lit(i), F.col("_key")) for i in range(trees)})
    drawn = drawn.select(*rows.drop("_key").columns, *[_times(F.col(f"_digits_{i}")).cast("byte").alias(f"_times_{i}") for i in range(trees)])
    data = io.written(drawn, "bags")  # a tree reads the features and its own draws

    def grown(i: int) -> dict:
        sample = data.withColumn("weight", F.col("_weight") * F.col(f"_times_{i}")).where("weight > 0")
        sample = _assembled(sample, features).select("features", "label", "weight")
        model = RandomForestClassifier(numTrees=1, bootstrap=False, maxDepth=max_depth, minInstancesPerNode=min_leaf, impurity="gini", featureSubsetStrategy="sqrt", weightCol="weight", seed=seed + i).fit(sample)
        return _tree_json(model.trees[0]._call_java("rootNode"), features)

    forest = side_by_side(df.sparkSession, [partial(grown, i) for i in range(trees)], at_once)
    return {"meta": {"version": "1", "features": features, "tree_count": trees, "config": {"max_depth": max_depth, "min_leaf": min_leaf, "n_trees": trees}, "bootstrap_seed": seed}, "forest": forest}


def _judged(df: DataFrame, model: dict, key: str, label: str) -> DataFrame:
    """key, label, and `votes`: in the order of the trees the leaf value of each that didn't see the row, null for the others."""
    seed, least = model["meta"]["bootstrap_seed"], digits_from(POISSON[0])
    # Each tree has its own expression: in a function over the leaves Spark would draw for all trees anew at each leaf.
    votes = [F.when(digits(seed, F.lit(i), F.col(key)) < least, F.col("_leaves")[i]) for i in range(len(model["forest"]))]
    return forest_leaves(df, model, "_leaves").select(key, F.col(label).cast("int").alias("label"), F.array(*votes).alias("votes"))


def out_of_bag(df: DataFrame, model: dict, key: str, label: str = "label") -> DataFrame:
    """Key, label, n_trees, score and correct (at 0.5) of each row, from the trees of train_bagged that didn't see it; null where all did."""
    votes = _judged(df, model, key, label).withColumn("votes", F.array_compact("votes")).withColumn("n_trees", F.size("votes"))
    score = F.when(F.col("n_trees") > 0, F.aggregate("votes", F.lit(0.0), lambda a, v: a + v) / F.col("n_trees"))
    return votes.select(key, "label", "n_trees", score.alias("score")).withColumn("correct", ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int"))


def tree_accuracy(df: DataFrame, model: dict, key: str, label: str = "label") -> DataFrame:
    """Tree, rows and accuracy (at 0.5) of each tree of train_bagged over the rows it didn't see."""
    sums = []
    for i in range(len(model["forest"])):
        vote = F.col("votes")[i]
        right = F.when(vote.isNotNull(), ((vote >= 0.5).cast("int") == F.col("label")).cast("double"))
        sums.append(F.struct(F.lit(i).alias("tree"), F.count(vote).alias("rows"), F.avg(right).alias("accuracy")))
    return _judged(df, model, key, label).agg(F.array(*sums).alias("trees")).select(F.inline("trees")).where("rows > 0")


def bootstrap_sizes(df: DataFrame, key: str, trees: int, seed: int = 42) -> DataFrame:
    """tree, rows in its sample, their repeats counted too, and rows out of it."""
    drawn = df.select(F.posexplode(F.array(*[bootstrap_weight(seed, i, F.col(key)) for i in range(trees)])).alias("tree", "weight"))
    return drawn.groupBy("tree").agg(F.count(F.when(F.col("weight") > 0, 1)).alias("in_bag"), F.sum("weight").alias("draws"), F.count(F.when(F.col("weight") == 0, 1)).alias("out_of_bag"))


def fit_platt(df: DataFrame, score: str = "score", label: str = "label", tolerance: float = 1e-8, most: int = 100) -> dict:
    """Coef and intercept of a sigmoid, by Newton steps; each step is one aggregate over counts of equal scores."""
    pairs = df.groupBy(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).where("s IS NOT NULL AND y IN (0, 1)").cache()
    try:
        sums = {r.y: r.n for r in pairs.groupBy("y").agg(F.sum("n").alias("n")).collect()}
        pos, neg = sums.get(1, 0), sums.get(0, 0)
        if pos + neg < 10:
            raise ValueError(f"calibration needs 10 rows or more, got {pos + neg}")
        if not pos or not neg:
            raise ValueError("calibration needs both classes")
        target = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
        a = b = 0.0
        steps = 0
        for steps in range(1, most + 1):
            p = apply_platt(F.col("s"), a, b)
            w = (p * (1 - p) + 1e-12) * F.col("n")
            d = (p - target) * F.col("n")
            ga, gb, haa, hab, hbb = pairs.agg(F.sum(d * F.col("s")), F.sum(d), F.sum(w * F.col("s") * F.col("s")), F.sum(w * F.col("s")), F.sum(w)).first()
            det = haa * hbb - hab * hab
            if abs(det) < 1e-20:
                break
            da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
            a, b = a + da, b + db
            if abs(da) < tolerance and abs(db) < tolerance:
                break
        return {"coef": round(a, 6), "intercept": round(b, 6), "samples": pos + neg, "iterations": steps}
    finally:
        pairs.unpersist()


# ---- thresholds ----


def thresholds(start: float = 0.05, end: float = 0.95, step: float = 0.01) -> list[float]:
    return [round(start + i * step, 3) for i in range(int((end - start) / step + 0.5) + 1)]


def threshold_scan(df: DataFrame, start: float = 0.05, end: float = 0.95, step: float = 0.01, score: str = "score", label: str = "label") -> DataFrame:
    """A row for each threshold with its counts and rates, 0 where a denominator is.

    Rows are counted by the number of thresholds they reach, so one aggregate of at most 92 groups a label goes through
    the shuffle; the thresholds' counts are running sums over these groups.
    """
    grid = thresholds(start, end, step)
    values = F.array(*[F.lit(t) for t in grid])
    s = F.col(score).cast("double")
    reached = F.when(s.isNull() | F.isnan(s), 0).otherwise(F.size(F.filter(values, lambda t: t <= s)))
    counts = df.where(F.col(label).isin(0, 1)).groupBy(reached.alias("k")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n"))
    totals = counts.agg(F.collect_list(F.struct("k", "p", "n")).alias("all"), F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("neg"))
    rows = totals.select("pos", "neg", "all", F.posexplode(values).alias("i", "threshold"))
    above = lambda c: F.aggregate(F.filter("all", lambda g: g["k"] > F.col("i")), F.lit(0).cast("long"), lambda a, g: a + g[c])
    rows = rows.select("threshold", above("p").alias("tp"), above("n").alias("fp"), "pos", "neg")
    rows = rows.withColumns({"tn": F.col("neg") - F.col("fp"), "fn": F.col("pos") - F.col("tp")})
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("pos"))
    return rows.select(
        "threshold", "tp", "fp", "tn", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(rate(F.col("fp"), F.col("neg")), 6).alias("fpr"),
        F.round(rate(F.col("fn"), F.col("pos")), 6).alias("fnr"), F.round(rate(2 * precision * recall, precision + recall), 6).alias("f1"), F.col("pos").alias("support_positive"), F.col("neg").alias("support_negative"))


def recommend_thresholds(scan: DataFrame, preset: str = "cli") -> DataFrame:
    """A row (warn, block) or none, from a scan's rows that hold the preset's limits.

    cli: the lowest pair at least the gap apart. in_process: the lowest and the highest, if they are.
    """
    recall, fpr, fnr, gap = PRESETS[preset]
    ok = scan.where((F.col("recall") >= recall) & (F.col("fpr") <= fpr) & (F.col("fnr") <= fnr)).select("threshold")
    if preset == "in_process":
        return ok.agg(F.min("threshold").alias("warn"), F.max("threshold").alias("block")).where(F.col("block") - F.col("warn") >= gap - 1e-9)
    other = ok.select(F.col("threshold").alias("block"))
    return ok.select(F.col("threshold").alias("warn")).join(other, F.col("block") - F.col("warn") >= gap - 1e-9).orderBy("warn", "block").limit(1)


def guardrails(model: dict, scores: DataFrame, preset: str = "in_process", most_bytes: int = MODEL_BYTES) -> dict:
    """Passed, failures and the recommended pair of a model and its calibrated scores."""
    failures = validate_model(model)
    cal = model.get("meta", {}).get("calibration")
    if not cal:
        failures.append("the model has no calibration")
    else:
        if not cal.get("coef", 0) > 0:
            failures.append("the calibration's coefficient isn't positive")
        if cal.get("samples", 100) < 100:
            failures.append("the calibration had fewer than 100 rows")
    size = len(json.dumps(model, separators=(",", ":")).encode())
    if size > most_bytes:
        failures.append(f"the model has {size} bytes")
    pair = recommend_thresholds(threshold_scan(scores), preset).first()
    if pair is None:
        failures.append("no pair of thresholds holds the limits")
    return {"passed": not failures, "failures": failures, "bytes": size, "warn": pair and pair.warn, "block": pair and pair.block}


# ---- evaluation ----


def _rates(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    share = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
    return [share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")]


def evaluate(df: DataFrame, by: list[str] | None = None, expected: str = "label", decision: str = "decision", latency: str = "latency") -> DataFrame:
    """Counts and rates in percent where only a block catches fraud; a warning lets it pass. By category, or of all."""
    fraud, blocked = F.col(expected) == 1, F.col(decision) == "block"
    n = lambda c: F.count(F.when(c, 1))
    sums = df.groupBy(*(by or [])).agg(F.count("*").alias("total"), n(fraud & blocked).alias("tp"), n(~fraud & blocked).alias("fp"), n(~fraud & ~blocked).alias("tn"), n(fraud & ~blocked).alias("fn"), F.avg(latency).alias("avg_latency"))
    return sums.select(*(by or []), "total", "tp", "fp", "tn", "fn", *_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]), "avg_latency")


def unlabelled_report(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """One row: counts and shares of decisions, the mean score, and counts of low, middle and high scores."""
    n = lambda c: F.count(F.when(c, 1))
    s = F.col(score)
    kinds = ("allow", "warn", "block")
    return df.agg(F.count("*").alias("total"), *[n(F.col("decision") == k).alias(k) for k in kinds], *[F.coalesce(F.try_divide(n(F.col("decision") == k) * 100.0, F.count("*")), F.lit(0.0)).alias(f"{k}_share") for k in kinds],
                  F.avg(s).alias("avg_score"), n(s < 0.3).alias("low"), n((s >= 0.3) & (s < 0.6)).alias("middle"), n(s >= 0.6).alias("high"))


def first_flagged(df: DataFrame, decision: str, key: str = "id", limit: int = 20) -> DataFrame:
    return df.where(F.col("decision") == decision).orderBy(key).limit(limit)


def detection_rate(df: DataFrame, score: str = "risk_score", latency: str = "latency") -> DataFrame:
    """One row: share of warnings and blocks, mean score, and latency's mean, deviation and interpolated percentiles."""
    shares = {f"p{round(p * 100)}": interpolated(p) for p in (0.5, 0.95, 0.99)}
    around = running_counts(df, latency).agg(*[c.alias(f"{k}_{i}") for k, three in shares.items() for i, c in enumerate(three)])
    places = around.select(*[(F.col(f"{k}_0") + (F.col(f"{k}_1") - F.col(f"{k}_0")) * F.col(f"{k}_2")).alias(k) for k in shares])
    sums = df.agg(F.count("*").alias("total"), F.coalesce(F.try_divide(F.count(F.when(F.col("decision").isin("warn", "block"), 1)) * 1.0, F.count("*")), F.lit(0.0)).alias("detection_rate"), F.avg(score).alias("avg_score"),
                  F.avg(latency).alias("avg_latency"), F.stddev_pop(latency).alias("stddev_latency"))
    return sums.crossJoin(places)  # both have one row


def floor_percentiles(df: DataFrame, latency: str = "latency", shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """T17's other form: the value of row floor(p * n), counted from 0, the last row at most."""
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("total")), F.col("total") - 1)
    return running_counts(df, latency).agg(*[at_rank(at(p)).alias(f"p{round(p * 100)}") for p in shares])


def conflict_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts, precision and recall (0 to 1) of predictions on conflict rows alone."""
    rows = df.where(conflict(F.col("bigram_entropy"), F.col("domain_reputation_score")))
    n = lambda a, b: F.count(F.when((F.col(predicted) == a) & (F.col(label) == b), 1))
    sums = rows.agg(F.count("*").alias("rows"), n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"))
    rate = lambda b: F.coalesce(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col(b)), F.lit(0.0))
    return sums.select("rows", "tp", "fp", "fn", rate("fp").alias("precision"), rate("fn").alias("recall"))


def random_search(df: DataFrame, features: list[str], draws: int = 25, folds: int = 5, key: str = "id", label: str = "label", seed: int = 42, top: int = 5, trees: tuple[int, int] = (25, 250), depth: tuple[int, int] = (4, 18), leaf: tuple[int, int] = (1, 50), at_once: int = 4) -> list[dict]:
    """The best of random settings by the mean area under the ROC curve over folds.

    Settings come from the seed alone, folds from a hash of the key. The features are packed into vectors once; fits of all draws and
    folds are independent jobs over them, `at_once` at a time. Areas are exact, from ranks of scores.
    """
    rng = random.Random(seed)
    settings = [{"trees": rng.randint(*trees), "max_depth": rng.randint(*depth), "min_leaf": rng.randint(*leaf)} for _ in range(draws)]
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"), (draw(seed, F.col(key)) % folds).alias("fold"))
    packed = _assembled(rows, features).select("features", "label", "fold").persist()

    def judged(p: dict, fold: int) -> float | None:
        model = RandomForestClassifier(numTrees=p["trees"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_leaf"], impurity="gini", featureSubsetStrategy="sqrt", seed=seed).fit(packed.where(F.col("fold") != fold))
        got = model.transform(packed.where(F.col("fold") == fold)).select(vector_to_array("probability")[1].alias("score"), "label")
        return roc_area(got).first().auc

    try:
        areas = side_by_side(df.sparkSession, [partial(judged, p, i) for p in settings for i in range(folds)], at_once)
    finally:
        packed.unpersist()
    known = [[a for a in areas[i * folds : (i + 1) * folds] if a is not None] for i in range(draws)]
    results = [{**p, "auc": sum(own) / len(own) if own else float("nan")} for p, own in zip(settings, known, strict=True)]
    return sorted(results, key=lambda r: (-r["auc"] if r["auc"] == r["auc"] else 1.0, r["trees"], r["max_depth"], r["min_leaf"]))[:top]


def train_until_passed(df: DataFrame, features: list[str], key: str = "id", label: str = "label", preset: str = "in_process", attempts: int = 3, trees: int = 10, max_depth: int = 6, conflict_by: float = 20.0, most_trees: int = 100, most_depth: int = 10, most_conflict: float = 40.0, seed: int = 42) -> dict:
    """Train, calibrate on held-out rows and check; while the check fails, again with more trees, a deeper one and heavier conflict rows."""
    fit, held = stratified_split(df, 0.8, seed, label, key, write_cuts=True)
    for n in range(1, attempts + 1):
        model = train_forest(fit, features, label, trees=trees, max_depth=max_depth, conflict_weight_by=conflict_by, seed=seed)
        raw = io.written(forest_score(held, model, 0).select("score", F.col(label).alias("label")), "scores")
        model["meta"]["calibration"] = fit_platt(raw)
        calibrated = raw.select(apply_platt(F.col("score"), model["meta"]["calibration"]["coef"], model["meta"]["calibration"]["intercept"]).alias("score"), "label")
        verdict = guardrails(model, calibrated, preset)
        if verdict["passed"]:
            break
        trees, max_depth, conflict_by = min(trees * 2, most_trees), min(max_depth + 1, most_depth), min(conflict_by * 1.5, most_conflict)
    return {"model": model, "attempts": n, **verdict}


def importance_ranking(spark: SparkSession, model: dict) -> DataFrame:
    """Features by importance."""
    rows = [(k, float(v)) for k, v in (model["meta"].get("feature_importance") or {}).items()]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def merge_datasets(parts: dict[str, tuple[DataFrame, str | None]], seed: int | None = 42, position: str = "position") -> DataFrame:
    """Datasets by source name, each with a label that overrides its own, or None: addresses in lower case, source tagged.

    With a seed each row has its position, from 0, in a random order of the whole; the order is one of a keyed hash of address, source and
    label, so it doesn't depend on partitions. Write it with repartitionByRange on the position to have files in that order.
    """
    out = None
    for source, (df, label) in parts.items():
        rows = df.withColumns({"email": F.lower("email"), "label": F.lit(label) if label is not None else F.col("label").cast("string"), "source": F.lit(source)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return numbered(out, seed, ["email", "source", "label"], name=position) if seed is not None else out


def sample_stats(samples: DataFrame) -> DataFrame:
    """One row: totals, by label and by source, and the oldest and newest times."""
    n = lambda c: F.count(F.when(c, 1))
    return samples.agg(F.count("*").alias("total"), n(F.col("label") == 1).alias("fraud"), n(F.col("label") == 0).alias("legit"),
                       *[n(F.col("label_source") == s).alias(s) for s in ("model", "manual", "known_disposable", "known_provider")], F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def label_by_source(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label", "label_source").agg(F.count("*").alias("count"))


def last_manual(samples: DataFrame, limit: int = 20) -> DataFrame:
    return samples.where("label_source = 'manual'").orderBy(F.desc("timestamp"), "email_hash").limit(limit)


def auc(df: DataFrame, score: str = "score", label: str = "label") -> float:
    return roc_area(df, score, label).first().auc
