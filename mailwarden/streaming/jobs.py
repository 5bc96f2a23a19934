"""Streaming jobs: scoring, samples, counts over time, limits, alerts, de-duplication. Each has a function from one
streaming frame to another, which batch frames can go through too where Spark allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.address import email_hash
from ..operators.scoring import Config, alert_rows, score_signups
from ..operators.training import auto_label, upsert_samples
from ..sources.io import to_log_rows
from .limits import limit_hits, limit_hits_stream
from .versions import VersionedTable

__all__ = ["limit_hits", "limit_hits_stream"]


def event_time(df: DataFrame, column: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """df with a time column that watermarks accept, and a watermark on it."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def score_stream(signups: DataFrame, as_of_year: int, model: dict | None = None, config: Config = Config(), **options) -> DataFrame:
    """ST1: the same scoring as in batches; it keeps no state."""
    return score_signups(signups, as_of_year, model, config, **options)


def start_scoring(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    rows = to_log_rows(scored).withColumn("date", F.to_date("timestamp"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def samples_of(scored: DataFrame, model_version: str = "1") -> DataFrame:
    score = "new_risk_score" if "new_risk_score" in scored.columns else "risk_score"
    labelled = scored.withColumn("l", auto_label(F.col("is_disposable"), F.col("is_free_provider"), F.col(score), F.col("decision")))
    return labelled.select("email_hash", F.to_json("feature_vector").alias("feature_vector"), "l.label", "l.label_source", F.col(score).alias("risk_score"), "decision", F.lit(model_version).alias("model_version"), F.col("timestamp").cast("timestamp").alias("timestamp"))


SAMPLE = "email_hash string, feature_vector string, label int, label_source string, risk_score double, decision string, model_version string, timestamp timestamp"


def samples_table(spark: SparkSession, path: str, buckets: int = 64, keep: int = 2) -> VersionedTable:
    return VersionedTable(spark, path, SAMPLE, "email_hash", buckets, keep)


def current_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples table that start_samples keeps, as its newest whole batch left it."""
    return samples_table(spark, path).current()


def start_samples(scored: DataFrame, path: str, checkpoint: str, buckets: int = 64, keep: int = 2, **trigger) -> StreamingQuery:
    """ST2: keep the samples table current: a batch merges the buckets that its addresses are in, and publishes them together.

    A batch that is run again after a failure starts from the same version and writes the same one; a stream with a new checkpoint goes on from the newest. Versions that the newest `keep` batches don't
    need are removed.
    """

    def merge(batch: DataFrame, n: int) -> None:
        samples_table(batch.sparkSession, path, buckets, keep).update(samples_of(batch), n, upsert_samples, checkpoint)

    return scored.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly_decisions(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """ST3: count and mean score by hour and decision."""
    rows = event_time(log, late=late).groupBy(F.window("timestamp", "1 hour"), "decision").agg(F.count("*").alias("count"), F.avg("risk_score").alias("avg_risk_score"))
    return rows.select(F.col("window.start").alias("hour"), "decision", "count", "avg_risk_score")


def busy_fingerprints(log: DataFrame, more_than: int = 10, late: str = "1 hour", length: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """ST4: fingerprints with more than so many rows in a sliding window."""
    rows = event_time(log, late=late).groupBy(F.window("timestamp", length, slide), "fingerprint_hash").agg(F.count("*").alias("count"), F.avg("risk_score").alias("avg_risk_score"))
    return rows.where(F.col("count") > more_than).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "fingerprint_hash", "count", "avg_risk_score")


def alert_stream(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """ST6."""
    return alert_rows(scored, config)


def distinct_signups(signups: DataFrame, email: str = "email", time: str = "timestamp", within: str = "1 hour") -> DataFrame:
    """ST7: the first sign-up of an address within the watermark; repeats go."""
    return event_time(signups, time, within).withColumn("email_hash", email_hash(F.col(email))).dropDuplicatesWithinWatermark(["email_hash"])
