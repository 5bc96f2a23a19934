"""Streaming jobs run to the end of the given events, with SQL for DuckDB that states what they should have found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import SIGNUPS_SQL, VALIDATIONS_SQL, WITH_SIGNUPS, WITH_VALIDATIONS
from ..sources.io import shared_folder
from ..streaming import jobs
from .log_queries import rounded
from .signup_oracles import HITS
from .signup_queries import MODEL, YEAR


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")


def signups_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SIGNUPS_SQL.replace("FROM events", "FROM {events}"), events=events_stream(spark, sf_dir))


def validations_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VALIDATIONS_SQL.replace("FROM signups", "FROM {signups}"), signups=signups_stream(spark, sf_dir))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given when its source is read to the end: the last complete result, or all appended rows.

    A batch writes a folder of its own, over what an earlier try of it has left.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


def st1_score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = jobs.score_stream(signups_stream(spark, sf_dir).drop("risk_score", "latency"), YEAR, MODEL)
    return rounded(finished(scored.select("id", "email", "decision", "risk_score", "block_reason"), "append"))


def st2_samples_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    scored = jobs.score_stream(signups_stream(spark, sf_dir).drop("risk_score", "latency"), YEAR, MODEL)
    jobs.start_samples(scored, f"{folder}/samples", f"{folder}/checkpoint").awaitTermination()
    return rounded(jobs.current_samples(spark, f"{folder}/samples").drop("feature_vector"))


def st3_hourly_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(finished(jobs.hourly_decisions(validations_stream(spark, sf_dir)), "complete"))


def st4_busy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(finished(jobs.busy_fingerprints(validations_stream(spark, sf_dir), 3, length="6 hours", slide="1 hour"), "complete"))


def st5_limit_hits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = validations_stream(spark, sf_dir).select("client_ip", "timestamp", "id")
    return finished(jobs.limit_hits_stream(log, seconds=3600, most=2), "append").select(F.col("id").cast("long").alias("id"), "limited")


def st6_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = jobs.score_stream(signups_stream(spark, sf_dir).drop("risk_score", "latency"), YEAR, MODEL)
    return rounded(finished(jobs.alert_stream(scored).withColumn("reasons", F.array_join("reasons", ",")), "append"))


def st7_distinct_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(jobs.distinct_signups(signups_stream(spark, sf_dir).select("email", "timestamp"), within="60 days").select("email_hash"), "append")


QUERIES = {f.__name__: f for f in (st1_score_stream, st2_samples_stream, st3_hourly_decisions, st4_busy_fingerprints, st5_limit_hits_stream, st6_alert_stream, st7_distinct_signups)}

ORACLE_SQL = {
    "st3_hourly_decisions": f"{WITH_VALIDATIONS} SELECT date_trunc('hour', timestamp) AS hour, decision, count(*) AS \"count\", round(avg(risk_score), 6) AS avg_risk_score FROM validations GROUP BY ALL",
    "st4_busy_fingerprints": f"{WITH_VALIDATIONS}, w AS (SELECT *, date_trunc('hour', timestamp) - to_hours(CAST(k AS INT)) AS start FROM validations, range(6) r(k)) SELECT start, start + INTERVAL 6 HOUR AS \"end\", fingerprint_hash, count(*) AS \"count\", round(avg(risk_score), 6) AS avg_risk_score FROM w GROUP BY ALL HAVING count(*) > 3",
    "st5_limit_hits_stream": f"{HITS} SELECT CAST(id AS BIGINT) AS id, hits > 2 AS limited FROM o",
    "st7_distinct_signups": f"{WITH_SIGNUPS} SELECT DISTINCT sha256(trim(lower(email))) AS email_hash FROM signups",
}
