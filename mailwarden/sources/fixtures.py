"""Sign-up and log tables derived from the `events` test table, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIGNUPS_SQL = """
SELECT
  event_id AS id,
  ts AS timestamp,
  user_id,
  CASE event_id % 10
    WHEN 0 THEN 'user' || CAST(event_id AS STRING)
    WHEN 1 THEN 'anna.smith' || CAST(1930 + event_id % 100 AS STRING)
    WHEN 2 THEN 'maria.lopez+' || CAST(event_id % 50 AS STRING)
    WHEN 3 THEN 'jo.hn.do.e'
    WHEN 4 THEN substr(md5(CAST(event_id AS STRING)), 1, 8 + CAST(event_id % 6 AS INT))
    WHEN 5 THEN 'signup_oct' || CAST(2015 + event_id % 12 AS STRING)
    WHEN 6 THEN 'test00' || CAST(event_id % 9 AS STRING)
    WHEN 7 THEN 'giovanni.rossi'
    WHEN 8 THEN 'dmitry_petrov' || CAST(60 + event_id % 40 AS STRING)
    ELSE 'qbekzs' || CAST(event_id % 1000 AS STRING)
  END || '@' ||
  CASE (event_id + user_id) % 12
    WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.com' WHEN 2 THEN 'outlook.com'
    WHEN 3 THEN 'mailinator.com' WHEN 4 THEN 'mail.com' WHEN 5 THEN 'proton.me'
    WHEN 6 THEN 'acme-corp.com' WHEN 7 THEN 'cs.stanford.edu' WHEN 8 THEN 'shop.vercel.app'
    WHEN 9 THEN 'win.tk' WHEN 10 THEN 'fake99mail.xyz' ELSE 'a.b.c.d.example.co'
  END AS email,
  CASE WHEN event_id % 5 < 2 THEN NULL WHEN event_id % 5 = 2 THEN 'Maria Lopez' WHEN event_id % 5 = 3 THEN 'Dmitry Petrov' ELSE 'Anna Smith' END AS name,
  CASE WHEN event_id % 10 IN (0, 4, 5, 6, 9) THEN 1 ELSE 0 END AS label,
  CASE user_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'BR' ELSE NULL END AS ip_country,
  CASE event_id % 4 WHEN 0 THEN 'en-US,en;q=0.9' WHEN 1 THEN 'de-DE' WHEN 2 THEN 'fr' ELSE NULL END AS accept_language,
  CAST((event_id * 37 + user_id * 101) % 1000 AS DOUBLE) / 1000 AS risk_score,
  value AS latency
FROM events
"""

VALIDATIONS_SQL = """
SELECT
  id,
  timestamp,
  CASE WHEN risk_score > 0.88 THEN 'block' WHEN risk_score > 0.56 THEN 'warn' ELSE 'allow' END AS decision,
  risk_score,
  CASE WHEN risk_score > 0.88 THEN
    CASE id % 4 WHEN 0 THEN 'disposable_domain' WHEN 1 THEN 'forest_v1' WHEN 2 THEN 'Invalid email format' ELSE NULL END
  END AS block_reason,
  substring(email, 1, position('@' IN email) - 1) AS email_local_part,
  substring(email, position('@' IN email) + 1) AS domain,
  md5(CAST(user_id % 40 AS STRING)) AS fingerprint_hash,
  CASE id % 6 WHEN 0 THEN 'sequential' WHEN 1 THEN 'dated' WHEN 2 THEN 'plus-addressing' WHEN 3 THEN 'simple' WHEN 4 THEN 'random' ELSE NULL END AS pattern_type,
  CASE WHEN id % 6 = 5 THEN NULL ELSE 'FAMILY' || CAST(id % 23 AS STRING) END AS pattern_family,
  CASE WHEN email LIKE '%@mailinator.com' THEN 1 ELSE 0 END AS is_disposable,
  CASE WHEN email LIKE '%@gmail.com' OR email LIKE '%@yahoo.com' OR email LIKE '%@outlook.com' THEN 1 ELSE 0 END AS is_free_provider,
  CAST((id * 13) % 90 AS DOUBLE) / 100 AS entropy_score,
  CASE WHEN id % 7 = 0 THEN NULL ELSE CAST((id * 17) % 100 AS DOUBLE) END AS bot_score,
  CAST((id * 7) % 10 AS DOUBLE) / 10 AS domain_reputation_score,
  CASE WHEN id % 3 = 0 THEN 'leaf' END AS decision_tree_reason,
  CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'unavailable' WHEN 2 THEN 'v1' WHEN 3 THEN 'v1' WHEN 4 THEN 'v2' ELSE 'v3' END AS model_version,
  '10.0.' || CAST(user_id % 7 AS STRING) || '.' || CAST(user_id % 50 AS STRING) AS client_ip,
  CASE WHEN id % 2 = 0 THEN 'exp1' END AS experiment_id,
  CASE WHEN id % 2 = 0 THEN CASE WHEN user_id % 3 = 0 THEN 'treatment' ELSE 'control' END END AS variant,
  ip_country AS country,
  latency,
  CASE WHEN name IS NULL THEN NULL ELSE CAST((id * 29) % 101 AS DOUBLE) / 100 END AS identity_similarity,
  CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id % 3 = 0 AS INT) END AS geo_language_mismatch,
  CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 4 = 0 AS INT) END AS geo_timezone_mismatch,
  CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(id % 5 <> 0 AS INT) END AS mx_has_records,
  CAST(id % 5 AS INT) AS mx_record_count,
  CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'google' WHEN 2 THEN 'microsoft' WHEN 3 THEN 'other' ELSE 'self_hosted' END AS mx_primary_provider,
  CASE WHEN id % 3 = 0 THEN '2.4.0' ELSE '2.5.0' END AS pattern_classification_version
FROM signups
"""

#: Common table expressions for DuckDB statements that start from these tables.
WITH_SIGNUPS = f"WITH signups AS ({SIGNUPS_SQL})"
WITH_VALIDATIONS = f"{WITH_SIGNUPS}, validations AS ({VALIDATIONS_SQL})"


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(SIGNUPS_SQL.replace("FROM events", "FROM {events}"), events=events)


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VALIDATIONS_SQL.replace("FROM signups", "FROM {signups}"), signups=signups(spark, sf_dir))
