"""Log queries over the derived tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as a
from ..sources.fixtures import WITH_VALIDATIONS, validations


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since sums of floats depend on their order."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on_log(f: Callable[..., DataFrame], **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(validations(spark, sf_dir), **options))

    return query


def _training_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = validations(spark, sf_dir).select("id", "timestamp", "decision", "model_version")
    return a.training_history(log.where("decision = 'block'"))


def _recent_rows(log: DataFrame, **options) -> DataFrame:
    """The log with the two columns that only a scored one has."""
    return a.recent_validations(log.withColumns({"tld_risk_score": (F.col("id") * 11 % 90) / 100, "pattern_confidence": F.when(F.col("id") % 4 != 0, (F.col("id") * 3 % 100) / 100)}), **options)


QUERIES = {
    "a1_summary": _on_log(a.summary, hours=168),
    "a2_block_reasons": _on_log(a.block_reasons, hours=168),
    "a3_risk_distribution": _on_log(a.risk_distribution, hours=168),
    "a4_top_countries": _on_log(a.top_countries, hours=168),
    "a5_performance": _on_log(a.performance, hours=168),
    "a6_bot_scores": _on_log(a.bot_scores, hours=168),
    "a7_timeline": _on_log(a.timeline, hours=168),
    "a8_top_fingerprints": _on_log(a.top_fingerprints, hours=168),
    "a9_high_risk": _on_log(a.high_risk, hours=168),
    "a10_disposable_domains": _on_log(a.disposable_domains, hours=168),
    "a11_pattern_families": _on_log(a.pattern_families, hours=168),
    "a12_identity_buckets": _on_log(a.identity_buckets, hours=168),
    "a13_geo_signals": _on_log(a.geo_signals, hours=168),
    "a14_mx_providers": _on_log(a.mx_providers, hours=168),
    "a15_page": _on_log(lambda log: a.page(log.select("id", "decision", "risk_score"), [F.desc("risk_score"), "id"], 50, 200)),
    "a16_ab_compare": _on_log(a.ab_compare, experiment_id="exp1", hours=168),
    "a17_ab_significance": _on_log(a.ab_significance, experiment_id="exp1", hours=168),
    "a18_threshold_preview": _on_log(a.threshold_preview, warn=0.5, block=0.8, hours=168),
    "a19_review_queue": _on_log(a.review_queue, hours=168),
    "a20_score_buckets": _on_log(a.score_buckets, hours=168),
    "a20_drift_summary": _on_log(a.drift_summary, hours=168),
    "a21_metrics_summary": _on_log(a.metrics_summary, hours=168),
    "a22_block_reason_share": _on_log(a.block_reason_share, hours=168),
    "a23_time_series": _on_log(a.time_series, hours=168),
    "a24_model_comparison": _on_log(a.model_comparison),
    "a24_latest_model": _on_log(a.latest_model),
    "a25_proxy_confusion": _on_log(a.proxy_confusion),
    "a26_block_rate_by_hour": _on_log(a.block_rate, by="hour"),
    "a26_block_rate_by_day": _on_log(a.block_rate, by="day", hours=168),
    "a27_top_blocked_emails": _on_log(a.top_blocked_emails),
    "a28_tree_performance": _on_log(a.tree_performance, hours=168),
    "a29_recent_validations": _on_log(_recent_rows, hours=168),
    "a30_latency_percentiles": _on_log(a.latency_percentiles, hours=168),
    "a31_fraud_rate": _on_log(a.fraud_rate),
    "a31_score_ranges": _on_log(a.score_ranges, hours=168),
    "a31_near_boundary": _on_log(a.near_boundary, hours=168),
    "a31_score_by_model": _on_log(a.score_by_model),
    "a32_purge_test_data": _on_log(lambda log: a.purge_test_data(log).select("id", "domain", "email_local_part", "pattern_type", "risk_score")),
    "a33_training_history": _training_events,
}

BUCKETS = "CASE WHEN risk_score < 0.2 THEN 'very_low' WHEN risk_score < 0.4 THEN 'low' WHEN risk_score < 0.6 THEN 'medium' WHEN risk_score < 0.8 THEN 'high' ELSE 'very_high' END"
BLOCKS = "count(*) FILTER (WHERE decision = 'block')"
WARNS = "count(*) FILTER (WHERE decision = 'warn')"
ALLOWS = "count(*) FILTER (WHERE decision = 'allow')"
EMAIL = "email_local_part || '@' || domain"


def _sql(body: str, hours: int | None = 168) -> str:
    rows = "SELECT * FROM validations" + (f" WHERE timestamp >= (SELECT max(timestamp) FROM validations) - INTERVAL {hours} HOUR" if hours else "")
    return f"{WITH_VALIDATIONS}, log AS ({rows}) {body}"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


COUNTS = f'count(*) AS "count", {_r("avg(risk_score)", "avg_risk_score")}'
_REVIEW = f"id, {EMAIL} AS email, round(risk_score, 6) AS risk_score, decision, round(entropy_score, 6) AS entropy_score, round(domain_reputation_score, 6) AS domain_reputation_score, pattern_type, model_version, timestamp, is_free_provider, country"

ORACLE_SQL = {
    "a1_summary": _sql(f"SELECT decision, block_reason, {BUCKETS} AS risk_bucket, date_trunc('hour', timestamp) AS hour, {COUNTS}, {_r('avg(entropy_score)', 'avg_entropy_score')}, {_r('avg(bot_score)', 'avg_bot_score')}, {_r('avg(latency)', 'avg_latency_ms')} FROM log GROUP BY ALL"),
    "a2_block_reasons": _sql(f"SELECT block_reason, pattern_classification_version, {COUNTS} FROM log WHERE decision = 'block' AND block_reason IS NOT NULL GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 20"),
    "a3_risk_distribution": _sql(f"SELECT {BUCKETS} AS risk_bucket, {COUNTS} FROM log GROUP BY ALL"),
    "a4_top_countries": _sql(f"SELECT country, {COUNTS} FROM log WHERE country IS NOT NULL GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 20"),
    "a5_performance": _sql(f"SELECT decision, count(*) AS \"count\", {_r('avg(latency)', 'avg_latency')}, {_r('min(latency)', 'min_latency')}, {_r('max(latency)', 'max_latency')} FROM log GROUP BY ALL"),
    "a6_bot_scores": _sql(f"SELECT CASE WHEN bot_score >= 80 THEN 'likely_human' WHEN bot_score >= 40 THEN 'uncertain' ELSE 'likely_bot' END AS bot_category, {COUNTS} FROM log WHERE bot_score IS NOT NULL GROUP BY ALL"),
    "a7_timeline": _sql(f"SELECT date_trunc('hour', timestamp) AS hour, decision, {COUNTS} FROM log GROUP BY ALL"),
    "a8_top_fingerprints": _sql(f"SELECT fingerprint_hash, country, count(*) AS validation_count, {_r('avg(risk_score)', 'avg_risk_score')} FROM log GROUP BY ALL HAVING count(*) > 10 ORDER BY 3 DESC, 1, 2 NULLS LAST LIMIT 20"),
    "a9_high_risk": _sql(f"SELECT id, timestamp, {EMAIL} AS email, {_r('risk_score', 'risk_score')}, decision, block_reason FROM log WHERE risk_score > 0.6 ORDER BY timestamp DESC, id LIMIT 100"),
    "a10_disposable_domains": _sql(f"SELECT domain, {COUNTS}, {BLOCKS} AS blocks FROM log WHERE is_disposable = 1 GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 20"),
    "a11_pattern_families": _sql(f"SELECT pattern_family, pattern_type, pattern_classification_version, {COUNTS}, {BLOCKS} AS blocks FROM log WHERE pattern_family IS NOT NULL GROUP BY ALL ORDER BY 4 DESC, 1 NULLS LAST, 2 NULLS LAST, 3 NULLS LAST LIMIT 20"),
    "a12_identity_buckets": _sql(f"SELECT CASE WHEN identity_similarity IS NULL THEN 'unknown' WHEN identity_similarity >= 0.8 THEN 'strong' WHEN identity_similarity >= 0.4 THEN 'partial' ELSE 'mismatch' END AS bucket, {COUNTS}, {_r('avg(identity_similarity)', 'avg_identity_similarity')} FROM log GROUP BY ALL"),
    "a13_geo_signals": _sql(" UNION ALL ".join(
        f"SELECT '{label}' AS label, count(*) AS \"count\", {_r('avg(risk_score)', 'avg_risk_score')} FROM log WHERE {c} HAVING count(*) > 0" for label, c in (
            ("Language mismatch", "geo_language_mismatch = 1"), ("Timezone mismatch", "geo_timezone_mismatch = 1"), ("Both mismatched", "geo_language_mismatch = 1 AND geo_timezone_mismatch = 1"),
            ("Aligned", "coalesce(geo_language_mismatch, 0) = 0 AND coalesce(geo_timezone_mismatch, 0) = 0")))),
    "a14_mx_providers": _sql(f"SELECT coalesce(mx_primary_provider, 'unknown') AS provider, {COUNTS}, {_r('avg(CASE WHEN mx_has_records = 1 THEN mx_record_count END)', 'avg_record_count')} FROM log GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 12"),
    "a15_page": _sql(f"SELECT id, decision, {_r('risk_score', 'risk_score')} FROM log ORDER BY log.risk_score DESC, id LIMIT 50 OFFSET 200", None),
    "a16_ab_compare": _sql(f"SELECT variant, experiment_id, count(*) AS total_requests, {BLOCKS} AS blocks, {WARNS} AS warns, {ALLOWS} AS allows, {_r('avg(risk_score)', 'avg_risk_score')}, {_r('avg(latency)', 'avg_latency_ms')}, {_r('avg(bot_score)', 'avg_bot_score')} FROM log WHERE experiment_id = 'exp1' GROUP BY ALL"),
    "a17_ab_significance": _sql(f"""
        , v AS (SELECT variant, CAST(count(*) AS DOUBLE) AS n, CAST({BLOCKS} AS DOUBLE) AS b, avg(risk_score) AS s FROM log WHERE experiment_id = 'exp1' GROUP BY 1),
        w AS (SELECT c.n AS cn, c.b AS cb, c.s AS cs, t.n AS tn, t.b AS tb, t.s AS ts FROM v c, v t WHERE c.variant = 'control' AND t.variant = 'treatment'),
        x AS (SELECT *, cn * (cb + tb) / (cn + tn) AS ce, tn * (cb + tb) / (cn + tn) AS te FROM w),
        y AS (SELECT *, (cb - ce) ** 2 / ce + (tb - te) ** 2 / te AS chi FROM x)
        SELECT round((tb / tn - cb / cn) / (cb / cn) * 100, 6) AS block_rate_change, round((ts - cs) / cs * 100, 6) AS risk_score_change, round(chi, 6) AS chi_square,
        CASE WHEN chi > 6.63 THEN 'p<0.01' WHEN chi > 3.84 THEN 'p<0.05' ELSE 'none' END AS significance FROM y"""),
    "a18_threshold_preview": _sql(f"""
        , p AS (SELECT *, CASE WHEN risk_score >= 0.8 THEN 'block' WHEN risk_score >= 0.5 THEN 'warn' ELSE 'allow' END AS new FROM log)
        SELECT count(*) AS total, {ALLOWS} AS current_allow, {WARNS} AS current_warn, {BLOCKS} AS current_block,
        {', '.join(f"count(*) FILTER (WHERE new = '{k}') AS projected_{k}, count(*) FILTER (WHERE new = '{k}' AND decision <> '{k}') AS to_{k}" for k in ('allow', 'warn', 'block'))} FROM p"""),
    "a19_review_queue": _sql(f"""
        , a AS (SELECT 'likely_fp' AS queue, {_REVIEW} FROM log WHERE decision IN ('block', 'warn') AND is_disposable = 0 AND entropy_score < 0.6 AND domain_reputation_score < 0.5 ORDER BY log.risk_score, id LIMIT 30),
        b AS (SELECT 'likely_fn' AS queue, {_REVIEW} FROM log WHERE decision = 'allow' AND (entropy_score > 0.55 OR domain_reputation_score > 0.7) ORDER BY log.risk_score DESC, id LIMIT 30),
        c AS (SELECT 'boundary' AS queue, {_REVIEW} FROM log WHERE risk_score BETWEEN 0.40 AND 0.95 ORDER BY round(abs(log.risk_score - 0.72), 9), id LIMIT 30)
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""),
    "a20_score_buckets": _sql(f"SELECT CASE WHEN risk_score < 0.2 THEN 'low (0-0.2)' WHEN risk_score < 0.4 THEN 'medium-low (0.2-0.4)' WHEN risk_score < 0.6 THEN 'medium (0.4-0.6)' WHEN risk_score < 0.8 THEN 'medium-high (0.6-0.8)' ELSE 'high (0.8-1.0)' END AS bucket, count(*) AS \"count\", {_r('avg(risk_score)', 'avg_score')}, {_r('avg(entropy_score)', 'avg_entropy')} FROM log GROUP BY ALL"),
    "a20_drift_summary": _sql(f"""
        , s AS (SELECT count(*) AS total, {_r('avg(risk_score)', 'avg_score')}, {_r(BLOCKS + ' * 100.0 / count(*)', 'block_rate')}, {_r(WARNS + ' * 100.0 / count(*)', 'warn_rate')}, {_r(ALLOWS + ' * 100.0 / count(*)', 'allow_rate')}, {_r('avg(latency)', 'avg_latency')} FROM log)
        SELECT *, CASE WHEN block_rate > 70 THEN 'high_block_rate' WHEN block_rate < 20 THEN 'low_block_rate' END AS drift FROM s"""),
    "a21_metrics_summary": _sql(f"SELECT count(*) AS total, {BLOCKS} AS blocks, {WARNS} AS warns, {ALLOWS} AS allows, {_r('avg(latency)', 'avg_latency')} FROM log"),
    "a22_block_reason_share": _sql(f"SELECT block_reason AS reason, count(*) AS \"count\", {_r('count(*) * 100.0 / (SELECT count(*) FROM log WHERE decision = ' + chr(39) + 'block' + chr(39) + ')', 'percentage')} FROM log WHERE decision = 'block' AND block_reason IS NOT NULL GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10"),
    "a23_time_series": _sql(f"SELECT date_trunc('hour', timestamp) AS hour, count(*) AS \"count\", {BLOCKS} AS blocks, {WARNS} AS warns FROM log GROUP BY ALL"),
    "a24_model_comparison": _sql(f"SELECT model_version, {_r('avg(risk_score)', 'avg_score')}, {_r('avg(latency)', 'avg_latency')}, count(*) AS predictions, {_r(BLOCKS + ' * 100.0 / count(*)', 'block_rate')}, {_r(ALLOWS + ' * 100.0 / count(*)', 'allow_rate')} FROM log WHERE model_version IS NOT NULL AND model_version <> 'unavailable' GROUP BY ALL ORDER BY 4 DESC, 1 LIMIT 5"),
    "a24_latest_model": _sql("SELECT model_version FROM log WHERE model_version IS NOT NULL AND model_version <> 'unavailable' ORDER BY timestamp DESC, id DESC LIMIT 1"),
    "a25_proxy_confusion": _sql(f"""
        , t AS (SELECT count(*) AS total, {BLOCKS} AS tp, {ALLOWS} AS tn, {WARNS} AS fp, CAST(0 AS BIGINT) AS fn FROM log WHERE decision_tree_reason IS NOT NULL),
        u AS (SELECT *, (tp + tn) * 100.0 / total AS accuracy, tp * 100.0 / (tp + fp) AS precision, tp * 100.0 / (tp + fn) AS recall FROM t)
        SELECT total, tp, tn, fp, fn, {_r('accuracy', 'accuracy')}, {_r('precision', 'precision')}, {_r('recall', 'recall')}, {_r('2 * precision * recall / (precision + recall)', 'f1')} FROM u"""),
    "a26_block_rate_by_hour": _sql(f"SELECT date_trunc('hour', timestamp) AS hour, count(*) AS total, {BLOCKS} AS blocks, round({BLOCKS} * 100.0 / count(*), 2) AS block_rate FROM log GROUP BY ALL", 24),
    "a26_block_rate_by_day": _sql(f"SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS day, count(*) AS total, {BLOCKS} AS blocks, round({BLOCKS} * 100.0 / count(*), 2) AS block_rate FROM log GROUP BY ALL"),
    "a27_top_blocked_emails": _sql(f"SELECT {EMAIL} AS email, count(*) AS block_count, coalesce(string_agg(DISTINCT block_reason, ',' ORDER BY block_reason), '') AS reasons FROM log WHERE decision = 'block' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "a28_tree_performance": _sql("SELECT decision, count(*) AS \"count\", round(avg(latency), 2) AS avg_latency, round(avg(risk_score), 3) AS avg_risk_score FROM log WHERE decision_tree_reason IS NOT NULL GROUP BY ALL"),
    "a29_recent_validations": _sql(f"SELECT id, {EMAIL} AS email, timestamp, decision, {_r('risk_score', 'risk_score')}, block_reason, country, pattern_type, is_disposable, is_free_provider, {_r('entropy_score', 'entropy_score')}, {_r('bot_score', 'bot_score')}, {_r('domain_reputation_score', 'domain_reputation_score')}, model_version, {_r('latency', 'latency')}, client_ip, fingerprint_hash, decision_tree_reason, round((id * 11 % 90) / 100, 6) AS tld_risk_score, round(CASE WHEN id % 4 <> 0 THEN (id * 3 % 100) / 100 END, 6) AS pattern_confidence FROM log ORDER BY timestamp DESC, id LIMIT 500"),
    "a30_latency_percentiles": _sql("""
        , r AS (SELECT latency, row_number() OVER (ORDER BY latency) AS n, count(*) OVER () AS total FROM log WHERE latency IS NOT NULL)
        SELECT round(max(latency) FILTER (WHERE n = floor(0.5 * total)), 6) AS p50, round(max(latency) FILTER (WHERE n = floor(0.95 * total)), 6) AS p95, round(max(latency) FILTER (WHERE n = floor(0.99 * total)), 6) AS p99 FROM r"""),
    "a31_fraud_rate": _sql(f"SELECT {_r(BLOCKS + ' * 100.0 / count(*)', 'fraud_rate')} FROM log", 1),
    "a31_score_ranges": _sql("SELECT CASE WHEN risk_score < 0.35 THEN '0.00-0.35' WHEN risk_score < 0.65 THEN '0.35-0.65' ELSE '0.65-1.00' END AS score_range, count(*) AS \"count\" FROM log GROUP BY ALL"),
    "a31_near_boundary": _sql(f"SELECT id, email_local_part, domain, {_r('risk_score', 'risk_score')}, decision, block_reason FROM log WHERE risk_score BETWEEN 0.3 AND 0.5 ORDER BY id LIMIT 20"),
    "a31_score_by_model": _sql(f"SELECT model_version, {_r('avg(risk_score)', 'avg_score')}, count(*) AS total FROM log GROUP BY ALL", None),
    "a32_purge_test_data": _sql(f"SELECT id, domain, email_local_part, pattern_type, {_r('risk_score', 'risk_score')} FROM log WHERE NOT coalesce(email_local_part LIKE 'user%' OR email_local_part LIKE 'test%' OR domain IN ('example.com', 'test.com') OR (pattern_type IS NULL AND log.risk_score < 0.6), false)", None),
    "a33_training_history": _sql("SELECT id, timestamp, decision, model_version FROM log WHERE decision = 'block' ORDER BY timestamp DESC, id DESC LIMIT 20", None),
}
