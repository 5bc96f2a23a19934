"""Readers, writers and checks of models as queries: what they write into the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, features
from ..sources import io
from ..sources.fixtures import WITH_VALIDATIONS, signups, validations
from ..sources.io import shared_folder
from .log_queries import rounded
from .signup_oracles import CLEAN, _q
from .signup_queries import DIRTY, MODEL


def io1_read_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of files, with their columns in another order and by other names."""
    df, folder = signups(spark, sf_dir), shared_folder(spark)
    kind, group = F.when(F.col("label") == 1, "fraud").otherwise("legit"), F.concat(F.lit('of "'), F.col("ip_country"), F.lit('", '), F.col("accept_language"))
    df.where("id % 2 = 0").select("email", kind.alias("type"), group.alias("category")).write.option("escape", '"').option("header", True).csv(f"{folder}/one")
    df.where("id % 2 = 1").select(group.alias("Subcategory"), kind.alias("label"), "id", F.col("email").alias("Email_Address")).write.option("escape", '"').option("header", True).csv(f"{folder}/two")
    return io.read_labeled(spark, [f"{folder}/one", f"{folder}/two"])


def io2_read_labeled_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each hundred sign-ups."""
    df, folder = signups(spark, sf_dir), shared_folder(spark)
    row = F.struct("email", F.when(F.col("label") == 1, "fraud").otherwise("legit").alias("type"), F.col("ip_country").alias("category"))
    files = df.groupBy(F.floor(F.col("id") / 100).alias("k")).agg(F.count("*").alias("count"), F.collect_list(row).alias("emails")).select(F.lit("now").alias("generated"), "count", "emails")
    files.write.option("maxRecordsPerFile", 1).json(folder)
    return io.read_labeled_json(spark, folder)


def io4_write_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    io.write_features(signups(spark, sf_dir), folder, ["risk_score", "latency", "id"], include_email=True)
    return spark.read.parquet(folder)


def io4_written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signups(spark, sf_dir).withColumn("score", F.when(F.col("id") % 9 != 0, F.col("risk_score")))
    counts = io.write_features(df, shared_folder(spark), ["score", "latency"], fmt="csv")
    return spark.createDataFrame([(counts["rows"], counts["positive"], counts["with_nulls"])], "rows long, positive long, with_nulls long")


def io5_partitioned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended in two parts, in folders by day, of which the look-back reads those it needs."""
    log, folder = validations(spark, sf_dir), shared_folder(spark)
    for part in (0, 1):
        io.append_validations(log.where(F.col("id") % 2 == part), folder)
    read = io.read_validations(spark, folder)
    return rounded(analytics.metrics_summary(read, hours=72).join(analytics.top_countries(read, hours=72).agg(F.max("count").alias("most")), how="cross"))


def io7_read_domain_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, folder = signups(spark, sf_dir), shared_folder(spark)
    domain = F.substring_index("email", "@", -1)
    df.select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("# "), domain)).when(F.col("id") % 7 == 0, "").when(F.col("id") % 2 == 0, F.upper(domain)).otherwise(F.concat(F.lit("  "), domain))).write.text(folder)
    return io.read_domain_list(spark, [folder])


def io8_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's decisions by country, as CSV and as JSON."""
    table, folder = validations(spark, sf_dir).groupBy("country", "decision").agg(F.count("*").alias("count")), shared_folder(spark)
    back = []
    for fmt in ("csv", "json"):
        io.export(table, f"{folder}/{fmt}", fmt)
        back.append(spark.read.schema(table.schema).options(**({"header": True} if fmt == "csv" else {})).format(fmt).load(f"{folder}/{fmt}").withColumn("format", F.lit(fmt)))
    return back[0].unionByName(back[1])


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signups(spark, sf_dir).select("id", F.expr(DIRTY).alias("email"), F.col("label").cast("string").alias("label"))


def c2_written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = io.write_clean(_dirty(spark, sf_dir), shared_folder(spark))
    return spark.createDataFrame([(counts["kept"], counts["duplicates"], counts["invalid"])], "kept long, duplicates long, invalid long")


def c2_written_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    io.write_clean(_dirty(spark, sf_dir).withColumn("label", F.when(F.col("label") == "1", "Fraud_x").otherwise("ham")), folder)
    return spark.read.parquet(f"{folder}/status=kept")


def a30_sketched_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches' percentiles against the log they stand for: which share of the rows is below each, and whether that is within 2 % of the one asked for."""
    log, folder = validations(spark, sf_dir), shared_folder(spark)
    analytics.latency_sketches(log).write.parquet(folder)
    found = analytics.sketched_percentiles(spark.read.parquet(folder))
    values = found.select("rows", F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.col(f"p{round(p * 100)}").alias("value")) for p in (0.5, 0.95, 0.99)])).alias("x")).select("rows", "x.*")
    below = log.where("latency IS NOT NULL").join(F.broadcast(values), F.col("latency") <= F.col("value")).groupBy("share").agg(F.count("*").alias("below"), F.max("rows").alias("rows"))
    return below.select("share", "rows", (F.abs(F.col("below") / F.col("rows") - F.col("share")) <= 0.02).alias("within"))


def f3_feature_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix's columns against the model's features and one that it lacks."""
    made = features.export_features(signups(spark, sf_dir), 2025, skip_mx=True)
    found = features.feature_alignment(made.columns, [*MODEL["meta"]["features"], "unheard_of"])
    return made.groupBy().agg(F.count("*").alias("rows")).select("rows", F.lit(",".join(found["missing"])).alias("missing"), F.lit(found["missing_ratio"]).alias("missing_ratio"), F.lit(found["ok"]).alias("ok"))


QUERIES = {f.__name__: f for f in (io1_read_labeled, io2_read_labeled_json, io4_write_features, io4_written_counts, io5_partitioned_log, io7_read_domain_list, io8_export, c2_written_counts, c2_written_rows, a30_sketched_percentiles, f3_feature_alignment)}

LABEL = "CASE WHEN label = 1 THEN 'fraud' ELSE 'legit' END"
ORACLE_SQL = {
    "io1_read_labeled": _q(f"SELECT trim(email) AS email, {LABEL} AS type, nullif(trim('of \"' || ip_country || '\", ' || accept_language), '') AS category FROM s"),
    "io2_read_labeled_json": _q(f"SELECT email, {LABEL} AS type, ip_country AS category FROM s"),
    "io4_write_features": _q("SELECT id, latency, risk_score, email, label FROM s"),
    "io4_written_counts": _q("SELECT count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE id % 9 = 0 OR latency IS NULL) AS with_nulls FROM s"),
    "io5_partitioned_log": f"{WITH_VALIDATIONS}, log AS (SELECT * FROM validations WHERE timestamp >= (SELECT max(timestamp) FROM validations) - INTERVAL 72 HOUR) SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'block') AS blocks, count(*) FILTER (WHERE decision = 'warn') AS warns, count(*) FILTER (WHERE decision = 'allow') AS allows, round(coalesce(avg(latency), 0), 6) AS avg_latency, (SELECT max(n) FROM (SELECT count(*) AS n FROM log WHERE country IS NOT NULL GROUP BY country)) AS most FROM log",
    "io7_read_domain_list": _q("SELECT DISTINCT d AS domain FROM s WHERE id % 5 != 0 AND id % 7 != 0"),
    "io8_export": f"{WITH_VALIDATIONS} SELECT country, decision, count(*) AS \"count\", format FROM validations, (VALUES ('csv'), ('json')) f(format) GROUP BY ALL",
    "c2_written_counts": _q(f"{CLEAN} SELECT count(DISTINCT clean) AS kept, count(clean) - count(DISTINCT clean) AS duplicates, count(*) FILTER (WHERE clean IS NULL) AS invalid FROM cl"),
    "c2_written_rows": _q(f"{CLEAN} SELECT min(id) AS id, clean AS email, CASE WHEN arg_min(label, id) = 1 THEN 'fraud' ELSE 'legit' END AS label, 'clean' AS source FROM cl WHERE clean IS NOT NULL GROUP BY clean"),
    "a30_sketched_percentiles": f"{WITH_VALIDATIONS} SELECT CAST(share AS DOUBLE) AS share, count(latency) AS rows, true AS within FROM validations, (VALUES (0.5), (0.95), (0.99)) v(share) GROUP BY 1",
    "f3_feature_alignment": _q("SELECT count(*) AS rows, 'unheard_of' AS missing, 0.25 AS missing_ratio, false AS ok FROM s WHERE length(trim(email)) > 0"),
}
