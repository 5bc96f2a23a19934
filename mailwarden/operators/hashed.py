"""Draws and orders from keyed hashes: the same on any number of partitions, and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a draw. A step of a search by draws, or a slice of an order, takes SLICE_BITS of them.
BITS, SLICE_BITS = 60, 12


def digits(seed: int | str, *keys: Column) -> Column:
    """A draw as 15 hex digits, which sort as the draws do."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])), 1, 15)


def draw(seed: int | str, *keys: Column) -> Column:
    """0 to 2^60 - 1: the first 15 hex digits of the MD5 of `seed|key|key...`; null keys count as empty."""
    return F.conv(digits(seed, *keys), 16, 10).cast("long")


def unit(seed: int | str, *keys: Column) -> Column:
    """A draw from 0 to 1."""
    return draw(seed, *keys) / float(1 << BITS)


def digits_from(share: float) -> str:
    """The digits of the least draw whose unit is `share` (from 0 to below 1) or more: `digits >= digits_from(share)` says what `unit >= share` does."""
    low, high = 0, 1 << BITS
    while low < high:
        at = (low + high) // 2
        low, high = (low, at) if at / float(1 << BITS) >= share else (at + 1, high)
    return f"{low:015x}"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[f"_{n}"])
    return out


def numbered(df: DataFrame, seed: int, keys: list[str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """df with each row's number, from 0, in the order of a keyed hash of `keys` (ties: the keys), within groups `by` or in all.

    The order is cut into 4,096 slices by the hash, even whatever the data: rows are counted by slice, the counts add up to each slice's
    offset, and a slice is numbered by itself. No task sorts more than a slice of a group. Rows equal in all keys are interchangeable.
    """
    by = by or []
    rows = df.withColumn("_draw", draw(seed, *[F.col(k) for k in keys]))
    rows = rows.withColumn("_slice", F.shiftright("_draw", BITS - SLICE_BITS))
    counts = rows.groupBy(*by, "_slice").agg(F.count("*").alias("n"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    names = [*by, "_slice"]
    offsets = counts.select(*[F.col(n).alias(f"_{n}") for n in names], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_draw", *keys))
    return rows.join(offsets, _same(rows, offsets, names)).withColumn(name, F.col("_offset") + within - 1).select(*df.columns, name)


def kth_least(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, d, k) of the row at a rank (from 1) of each group g, in the order of draws d, then keys k. rows: g, d, k; ranks: g, rank.

    Draws are searched SLICE_BITS at a time: the slice that holds the rank is found from running counts of slices, then the search goes on
    inside it. After two steps a group has one row in 16 million left to sort.
    """
    left, wanted = rows, ranks
    for step in (1, 2):
        part = F.shiftright("d", BITS - step * SLICE_BITS)
        counts = left.groupBy("g", part.alias("s")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(W.partitionBy("g").orderBy("s")))
        asked = wanted.select(F.col("g").alias("_g"), "rank")
        hit = counts.join(asked, _same(counts, asked, ["g"])).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        hit = hit.select(F.col("g").alias("_g"), F.col("s").alias("_s"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
        left = left.withColumn("s", part)
        left = left.join(hit.select("_g", "_s"), _same(left, hit, ["g", "s"])).select("g", "d", "k")
        wanted = hit.select(F.col("_g").alias("g"), "rank")
    ordered = left.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("d", "k")))
    asked = wanted.select(F.col("g").alias("_g"), "rank")
    return ordered.join(asked, _same(ordered, asked, ["g"]) & (F.col("r") == F.col("rank"))).select("g", "d", "k")
