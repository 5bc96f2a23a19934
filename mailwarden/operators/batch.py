"""Batch abuse detection: groups of addresses that belong together. `by` names columns that divide the table into
separate lists. Groups are counted first; addresses are collected only for groups past their threshold, and at most
`most_listed` of each (in order), which bounds a row's size; counts are of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.address import local_part, normalize_email

# Shares of first digits, and critical values of chi-square with 8 degrees of freedom.
BENFORD = (0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046)
CRITICAL = {0.10: 13.362, 0.05: 15.507, 0.01: 20.090}


def _list(df: DataFrame, keys: list[str], of: dict[str, str], most: int) -> DataFrame:
    """The least `most` rows of each group as arrays. Spark limits each task's part of a group before it shuffles."""
    order = W.partitionBy(*keys).orderBy(*of)
    first = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *of))).alias("rows"))
    return rows.select(*keys, *[F.col(f"rows.{c}").alias(out) for c, out in of.items()])


def _top(groups: DataFrame, by: list[str], key: str) -> DataFrame:
    """The largest group of each list; ties go to the least key."""
    row = F.struct(*[c for c in groups.columns if c not in by])
    best = groups.groupBy(*by).agg(F.min_by(row, F.struct(-F.col("count"), F.col(key))).alias("top"))
    return best.select(*by, "top.*")


def plus_alias_groups(df: DataFrame, email: str = "email", by: list[str] | None = None, most_listed: int = 1000) -> DataFrame:
    """B1: for each list the largest group of addresses with one canonical form: canonical, count, has_abuse (3 or more), confidence, variants."""
    by = by or []
    rows = df.where(F.col(email).isNotNull()).withColumn("canonical", normalize_email(F.col(email))["provider_normalized"])
    groups = _top(rows.groupBy(*by, "canonical").agg(F.count("*").alias("count")), by, "canonical")
    listed = _list(rows.join(groups.select(*by, "canonical"), [*by, "canonical"], "left_semi"), [*by, "canonical"], {email: "variants"}, most_listed)
    out = groups.join(listed, [*by, "canonical"], "left")
    abuse = F.col("count") >= 3
    return out.withColumns({"has_abuse": abuse, "confidence": F.when(abuse, F.least(0.6 + F.col("count") * 0.1, F.lit(1.0))).otherwise(0.0)})


def plus_tag_pattern(df: DataFrame, email: str = "email", by: list[str] | None = None) -> DataFrame:
    """B2: for each canonical address how its tags are made: none, sequential, dated or keyword, with a confidence.

    Gaps between numeric tags are found on the sorted distinct numbers: repeated numbers have gaps of 0.
    """
    keys = [*(by or []), "canonical"]
    n = normalize_email(F.col(email))
    rows = df.where(F.col(email).isNotNull()).withColumn("n", n).select(*(by or []), F.col("n.provider_normalized").alias("canonical"), F.col("n.plus_tag").alias("tag")).where(F.length("tag") > 0)
    number = F.when(F.col("tag").rlike("^[0-9]+$"), F.col("tag").try_cast("decimal(38,0)"))
    tags = rows.groupBy(*keys, "tag").agg(F.count("*").alias("n")).withColumn("number", number)
    tags = tags.withColumn("gap", F.col("number") - F.lag("number").over(W.partitionBy(*keys).orderBy("number")))
    sums = tags.groupBy(*keys).agg(
        F.sum("n").alias("n_tags"), F.sum(F.when(F.col("number").isNotNull(), F.col("n"))).alias("n_numeric"), F.coalesce(F.bool_or(F.col("gap") > 5), F.lit(False)).alias("wide"),
        F.bool_or(F.col("tag").rlike("20[0-9]{2}|(?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")).alias("dates"), F.count_distinct(F.lower("tag")).alias("kinds"))
    steady = (F.col("n_numeric") >= 2) & ~F.col("wide")
    kind = F.when(F.col("n_tags") < 2, "none").when(steady, "sequential").when(F.col("dates"), "dated").when((F.col("kinds") == 1) & (F.col("n_tags") >= 3), "keyword").otherwise("none")
    out = sums.withColumn("pattern", kind)
    return out.select(*keys, "n_tags", "pattern", F.when(kind == "sequential", 0.85).when(kind == "dated", 0.75).when(kind == "keyword", 0.8).otherwise(0.0).alias("confidence"))


def _dominant(rows: DataFrame, by: list[str], email: str, base: float, step: float, lists: dict[str, str], most: int) -> DataFrame:
    top = _top(rows.groupBy(*by, "family").agg(F.count("*").alias("count")), by, "family").where("count >= 2")
    listed = _list(rows.join(top.select(*by, "family"), [*by, "family"], "left_semi"), [*by, "family"], lists, most)
    return top.join(listed, [*by, "family"], "left").withColumn("confidence", F.least(F.lit(base) + F.col("count") * step, F.lit(1.0)))


def sequential_batch(df: DataFrame, as_of_year: int, email: str = "email", by: list[str] | None = None, most_listed: int = 1000) -> DataFrame:
    """The largest numbered family of each list, if two or more addresses have it."""
    rows = df.withColumn("family", patterns.sequential_family(F.col(email), as_of_year)).where("family IS NOT NULL")
    return _dominant(rows, by or [], email, 0.5, 0.15, {email: "matching"}, most_listed)


def dated_batch(df: DataFrame, as_of_year: int, email: str = "email", by: list[str] | None = None, most_listed: int = 1000) -> DataFrame:
    """The largest dated family of each list, if two or more addresses have it, with its date components."""
    rows = df.withColumn("family", patterns.dated_family(F.col(email), as_of_year)).where("family IS NOT NULL").withColumn("component", patterns.dated(F.col(email), as_of_year)["date_component"])
    return _dominant(rows, by or [], email, 0.7, 0.1, {email: "matching", "component": "dates"}, most_listed)


def alias_members(df: DataFrame, email: str = "email", by: list[str] | None = None) -> DataFrame:
    """B1's lists in full: every row of df that is in its list's largest alias group, with `canonical`. No row holds a group, so groups may have any size."""
    rows = df.where(F.col(email).isNotNull()).withColumn("canonical", normalize_email(F.col(email))["provider_normalized"])
    top = _top(rows.groupBy(*(by or []), "canonical").agg(F.count("*").alias("count")), by or [], "canonical")
    return _members(rows, top, [*(by or []), "canonical"])


def sequential_members(df: DataFrame, as_of_year: int, email: str = "email", by: list[str] | None = None) -> DataFrame:
    """B3's lists in full: every row of df in its list's largest numbered family of two or more, with `family`."""
    rows = df.withColumn("family", patterns.sequential_family(F.col(email), as_of_year)).where("family IS NOT NULL")
    return _members(rows, _top(rows.groupBy(*(by or []), "family").agg(F.count("*").alias("count")), by or [], "family").where("count >= 2"), [*(by or []), "family"])


def dated_members(df: DataFrame, as_of_year: int, email: str = "email", by: list[str] | None = None) -> DataFrame:
    """B4's lists in full: every row of df in its list's largest dated family of two or more, with `family` and its date `component`."""
    rows = df.withColumn("family", patterns.dated_family(F.col(email), as_of_year)).where("family IS NOT NULL")
    found = _members(rows, _top(rows.groupBy(*(by or []), "family").agg(F.count("*").alias("count")), by or [], "family").where("count >= 2"), [*(by or []), "family"])
    return found.withColumn("component", patterns.dated(F.col(email), as_of_year)["date_component"])


def _members(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the groups. A group with many rows is one row on the other side, so Spark splits it over tasks."""
    return rows.join(groups.select(*keys), keys, "left_semi")


def pattern_families(df: DataFrame, as_of_year: int, email: str = "email", by: list[str] | None = None) -> DataFrame:
    """Each family's count, type, whether it is suspicious and whether it is its list's largest; by count."""
    by = by or []
    rows = df.where(F.col(email).isNotNull()).withColumn("f", patterns.pattern_family(F.col(email), as_of_year))
    sizes = rows.groupBy(*by, F.col("f.family").alias("family"), F.col("f.type").alias("type")).agg(F.count("*").alias("count"))
    families = sizes.groupBy(*by, "family").agg(F.sum("count").alias("count"), F.max_by("type", F.struct("count", "type")).alias("type"))
    top = _top(families.where("family IS NOT NULL"), by, "family").select(*by, F.col("family").alias("family"), F.lit(True).alias("is_top"))
    out = families.join(top, [*by, "family"], "left").withColumn("is_top", F.coalesce("is_top", F.lit(False)))
    out = out.withColumn("suspicious", (F.col("count") >= 5) | (F.col("count") >= 3) & F.col("type").isin("sequential", "dated"))
    return out.orderBy(F.desc("count"), "family")


def p_value(chi: Column, df: int = 8) -> Column:
    """The upper tail of chi-square: Wilson and Hilferty's normal approximation, and a polynomial for the normal's tail."""
    spread = (2 / (9 * df)) ** 0.5
    z = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / spread
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.lit(0.3989422804014327) * F.exp(-0.5 * z * z) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(chi <= 0, 1.0).when(z < -8, 1.0).when(z > 8, 0.0).when(z >= 0, tail).otherwise(1 - tail)


def benford(df: DataFrame, email: str = "email", by: list[str] | None = None, level: float = 0.05) -> DataFrame:
    """First digits of the numbers in each list's local parts against Benford's law.

    sample_size, distribution (digits 1 to 9), chi_square, p_value, follows, confidence, deviation, risk, automated,
    suspicious. Under 30 digits nothing is evaluated: zeros, p_value 1. Digits are counted before they meet, nine a list.
    """
    by = by or []
    runs = F.explode(F.regexp_extract_all(local_part(F.col(email)), F.lit("[0-9]+"), F.lit(0)))
    digits = df.select(*by, runs.alias("run")).select(*by, F.substring("run", 1, 1).cast("int").alias("digit")).where("digit > 0")
    addresses = df.groupBy(*by).agg(F.count(email).alias("n_addresses"))
    counts = digits.groupBy(*by, "digit").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("sample_size"), *[F.coalesce(F.sum(F.when(F.col("digit") == i, F.col("n"))), F.lit(0)).alias(f"d{i}") for i in range(1, 10)])
    rows = addresses.join(counts, by, "left") if by else addresses.crossJoin(counts)  # without keys both have one row
    size = F.coalesce("sample_size", F.lit(0))
    enough = size >= 30
    share = [F.when(enough, F.col(f"d{i}") / size).otherwise(0.0) for i in range(1, 10)]
    rows = rows.withColumns({"sample_size": size, "distribution": F.array(*share)})
    obs = lambda i: F.col("distribution")[i]
    n = F.col("sample_size")
    rows = rows.withColumn("chi_square", F.when(n >= 30, sum(F.pow((obs(i) - BENFORD[i]) * n, 2) / (BENFORD[i] * n) for i in range(9))).otherwise(0.0))
    rows = rows.withColumn("deviation", F.when(n >= 30, sum(F.abs(obs(i) - BENFORD[i]) for i in range(9)) / 9).otherwise(0.0))
    critical = CRITICAL[level]
    rows = rows.withColumns({"p_value": F.when(n >= 30, p_value(F.col("chi_square"))).otherwise(1.0), "follows": (n >= 30) & (F.col("chi_square") < critical)})
    rows = rows.withColumn("confidence", F.when(F.col("follows"), F.greatest(F.lit(0.0), 1 - F.col("chi_square") / critical)).otherwise(0.0))
    risk = F.least(F.greatest(F.when(~F.col("follows"), F.least(F.col("chi_square") / 30, F.lit(1.0))).otherwise(0.0), F.col("deviation") * 2), F.lit(1.0))
    rows = rows.withColumn("risk", F.when(n >= 30, risk).otherwise(0.0))
    return rows.select(*by, "sample_size", "distribution", "chi_square", "p_value", "follows", "confidence", "deviation", "risk", (F.col("risk") > 0.7).alias("automated"),
                       ((F.col("n_addresses") >= 30) & ~F.col("follows") & (F.col("deviation") > 0.1)).alias("suspicious"))


def compare_distributions(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The cosine of two lists' digit distributions, by shared keys; similar above 0.9."""
    both = a.select(*by, F.col("distribution").alias("x")).join(b.select(*by, F.col("distribution").alias("y")), by)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col("x"), F.col("y")
    cosine = F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))
    return both.select(*by, cosine.alias("similarity"), (cosine > 0.9).alias("similar"))
