"""Exact order statistics without a task that sees all values."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranged(df: DataFrame, value: str, parts: int) -> DataFrame:
    """df's rows whose value isn't null, with `part`: the number of one of at most `parts` ranges of values of about as many rows."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_d", F.col(value).cast("double"))
    cuts = rows.agg(F.percentile_approx("_d", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    inner = sorted({c for c in cuts or [0.0] if abs(c) != float("inf")}) or [0.0]
    return Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_d", outputCol="part", handleInvalid="keep").transform(rows).drop("_d")


def running_counts(df: DataFrame, value: str, parts: int = 1000) -> DataFrame:
    """(v, upto, total) for each distinct value that isn't null: how many rows have it or less, and how many there are.

    Approximate quantiles cut the values into at most `parts` ranges of about as many rows. Running sums go within a
    range; the ranges' own sums are a table of at most `parts` rows, the only thing that one task adds up.
    """
    counts = ranged(df.select(F.col(value).alias("v")), "v", parts).groupBy("part", "v").agg(F.count("*").alias("n"))
    sums = counts.groupBy("part").agg(F.sum("n").alias("in_part"))
    before = sums.select("part", (F.sum("in_part").over(W.orderBy("part")) - F.col("in_part")).alias("before"), F.sum("in_part").over(W.partitionBy()).alias("total"))
    run = F.sum("n").over(W.partitionBy("part").orderBy("v"))
    return counts.withColumn("run", run).join(F.broadcast(before), "part").select("v", (F.col("before") + F.col("run")).alias("upto"), "total")


def roc_area(df: DataFrame, score: str = "score", label: str = "label", parts: int = 200) -> DataFrame:
    """One row: auc (null without both classes), positives, negatives: the share of pairs of a positive and a negative row that the score orders
    right, ties counting half. Rows without score or a label of 0 or 1 don't count.

    Running counts of negatives go within ranges of scores; only the ranges' sums meet.
    """
    rows = df.select(F.col(score).cast("double").alias("v"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)")
    counts = ranged(rows, "v", parts).groupBy("part", "v").agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("n"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pairs = counts.withColumn("pairs", F.col("p") * (within + F.col("n") / 2))
    by_part = pairs.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("pairs").alias("pairs"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = by_part.withColumn("all", F.col("pairs") + F.col("p") * before).agg(F.sum("all").alias("a"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"))
    return total.select(F.try_divide("a", F.col("positives") * F.col("negatives").cast("double")).alias("auc"), "positives", "negatives")


def at_rank(rank: Column) -> Column:
    """Over running_counts: the value at a rank counted from 0."""
    return F.min(F.when(F.col("upto") > rank, F.col("v")))


def interpolated(share: float) -> list[Column]:
    """Over running_counts: the two values around a share of the way from the first to the last, and the place between them."""
    place = F.lit(share) * (F.col("total") - 1)
    return [at_rank(F.floor(place)), at_rank(F.ceil(place)), F.max(place - F.floor(place))]
