"""Queries over derived sign-ups: cleaning, patterns, statistics, domains, features, scoring, groups, training."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as a
from ..functions import domains as d
from ..functions import identity as i
from ..functions import lexical as x
from ..functions import ngrams as n
from ..functions import patterns as p
from ..operators import batch as b
from ..operators import features as f
from ..operators import scoring as s
from ..operators import synthetic as syn
from ..operators import training as t
from ..sources import io
from ..sources.fixtures import signups, validations
from ..streaming import jobs
from .log_queries import rounded

YEAR = 2025
#: Addresses with the marks that cleaning takes off, in SQL that both engines run.
DIRTY = """CASE id % 7 WHEN 0 THEN ' <' || upper(email) || '> ' WHEN 1 THEN 'mailto:' || email WHEN 2 THEN '"' || email || '".,' WHEN 3 THEN replace(email, '.', '..')
  WHEN 4 THEN replace(email, '@', ' @ ') WHEN 5 THEN replace(email, '@', '') ELSE email END"""
ODD = "CASE id % 9 WHEN 0 THEN replace(email, '.', '') WHEN 1 THEN 'a' || substr(email, instr(email, '@')) WHEN 2 THEN email || '.x' WHEN 3 THEN 'é' || email WHEN 4 THEN 'b c' || email ELSE email END"
#: Addresses with dates of every form, with numbers between marks, and with names of many languages.
DATES = """CASE id % 6 WHEN 0 THEN 'ann.' || CAST(1930 + id % 100 AS STRING) || lpad(CAST(id % 14 AS STRING), 2, '0') || lpad(CAST(id % 33 AS STRING), 2, '0') WHEN 1 THEN CAST(1990 + id % 40 AS STRING) || '.carla'
  WHEN 2 THEN 'bob_' || CAST(1950 + id % 80 AS STRING) || '-' || lpad(CAST(id % 13 AS STRING), 2, '0') || '-' || lpad(CAST(id % 32 AS STRING), 2, '0') || '.x'
  WHEN 3 THEN 'eve' || CASE id % 4 WHEN 0 THEN 'jan' WHEN 1 THEN 'sept' WHEN 2 THEN 'march' ELSE '07' END || CAST(1960 + id % 70 AS STRING) WHEN 4 THEN 'kimmy' || lpad(CAST(id % 100 AS STRING), 2, '0') ELSE 'lee.' || CAST(1940 + id % 90 AS STRING) || '_z' END || '@gmail.com'"""
BETWEEN = "CASE id % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'o.neil' ELSE 'x' END || CASE id % 4 WHEN 0 THEN '.' WHEN 1 THEN '_' ELSE '-' END || CASE WHEN id % 5 = 0 THEN '0' ELSE '' END || CAST(id % 2000 AS STRING) || CASE id % 2 WHEN 0 THEN '_' ELSE '.' END || 'shop@acme-corp.com'"
NAMES = "CASE id % 12 WHEN 0 THEN 'petrovich' WHEN 1 THEN 'gonzalez' WHEN 2 THEN 'moreau' WHEN 3 THEN 'hartmann' WHEN 4 THEN 'bellini' WHEN 5 THEN 'sousinha' WHEN 6 THEN 'abdurrahman' WHEN 7 THEN 'kumarsingh' WHEN 8 THEN 'nguyen' WHEN 9 THEN 'zhangxiao' WHEN 10 THEN 'smithson' ELSE 'schulze' END || CASE WHEN id % 7 = 0 THEN '' ELSE CAST(id % 50 AS STRING) END || '@gmail.com'"
FIRST_PART = "substr(email, 1, instr(email, '@') - 1)"
#: A tiny forest over real features.
MODEL = {
    "meta": {"version": "t1", "features": ["digit_ratio", "entropy_score", "tld_risk_score"], "tree_count": 2, "config": {"max_depth": 6}, "calibration": {"coef": 4.0, "intercept": -2.0, "samples": 1000}},
    "forest": [
        {"t": "n", "f": "digit_ratio", "v": 0.3, "l": {"t": "n", "f": "tld_risk_score", "v": 0.5, "l": {"t": "l", "v": 0.1}, "r": {"t": "l", "v": 0.7}}, "r": {"t": "l", "v": 0.9}},
        {"t": "n", "f": "entropy_score", "v": 0.45, "l": {"t": "l", "v": 0.2}, "r": {"t": "l", "v": 0.6}}]}
TREE = {"type": "node", "feature": "digit_ratio", "threshold": 0.3, "left": {"type": "leaf", "value": 0.2, "reason": "few_digits"},
        "right": {"type": "node", "feature": "tld_risk_score", "threshold": 0.5, "operator": ">", "left": {"type": "leaf", "value": 0.95, "reason": "bad_tld"}, "right": {"type": "leaf", "value": 0.6, "reason": "digits"}}}


def wide(df: DataFrame, *keep: str, **structs: Column) -> DataFrame:
    """keep, and the fields of struct columns as columns of their own, rounded."""
    made = df.select(*keep, *[v.alias(k) for k, v in structs.items()])
    cols = []
    for k in structs:
        kind = made.schema[k].dataType
        cols += [F.col(f"{k}.{field}").alias(field) for field in kind.names] if hasattr(kind, "names") else [F.col(k)]
    return rounded(made.select(*keep, *cols))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a small file would give one task the work of many columns for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _rows(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(signups(spark, sf_dir))


def _log(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(build(validations(spark, sf_dir)))


E = lambda: F.col("email")
LOCAL = lambda: a.local_part(a.tidy(E()))
DOMAIN = lambda: a.domain_part(a.tidy(E()))


def _c2(df: DataFrame) -> DataFrame:
    kept, _ = a.clean_dataset(df.select("id", F.expr(DIRTY).alias("email"), F.when(F.col("label") == 1, "Fraud_x").otherwise("ham").alias("label")))
    return kept


def _c2_counts(df: DataFrame) -> DataFrame:
    return a.clean_dataset(df.select("id", F.expr(DIRTY).alias("email"), F.col("label").cast("string").alias("label")))[1]


def _with_domain(df: DataFrame) -> DataFrame:
    return df.select("id", "email").withColumn("domain", DOMAIN())


def _d1(df: DataFrame) -> DataFrame:
    return wide(d.with_disposable(_with_domain(df)), "id", v=d.validate_domain(F.col("domain"), F.col("listed")))


def _d4(df: DataFrame) -> DataFrame:
    return rounded(d.with_disposable(_with_domain(df)).select("id", d.domain_reputation(F.col("domain"), F.col("listed")).alias("reputation")))


def _d5(df: DataFrame) -> DataFrame:
    return wide(d.with_tld(_with_domain(df)), "id", v=F.col("tld"))


def _d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose multiplier follows the share of sign-ups on their TLD that the labels call fraud."""
    seen = signups(spark, sf_dir).groupBy(F.substring_index("email", ".", -1).alias("tld")).agg((F.avg("label") * 3).alias("risk_multiplier"))
    profiles = d.tld_table(spark)
    return rounded(d.override_profiles(profiles, seen.join(profiles.select("tld"), "tld", "left_semi")))


def _mx_records(df: DataFrame) -> DataFrame:
    """A record for some sign-ups' domains, so that the table grows with the sign-ups."""
    host = F.element_at(F.array(*[F.lit(h) for h in ("alt1.l.google.com.", "x.mail.protection.outlook.com.", "mx.zoho.com.", "mail.other.net.", "SELF")]), (F.col("id") % 5 + 1).cast("int"))
    domain = DOMAIN()
    data = F.when(F.col("id") % 11 == 0, "bad").otherwise(F.concat((F.col("id") % 50).cast("string"), F.lit(" "), F.when(host == "SELF", F.concat(F.lit("mx."), domain, F.lit("."))).otherwise(host)))
    return df.select(F.concat((F.col("id") % 97).cast("string"), F.lit("."), domain).alias("domain"), F.col("id").alias("position"), data.alias("data"), F.col("id").alias("ttl"))


def _d9(df: DataFrame) -> DataFrame:
    resolved = d.mx_analysis(_mx_records(df).withColumn("domain", F.regexp_replace("domain", r"^[0-9]+\.", "")))
    return d.with_mx(_with_domain(df), "domain", resolved).select("id", "domain", "mx_record_count", "mx_primary_provider", "mx_has_records")


def _features(df: DataFrame, **options) -> DataFrame:
    return f.export_features(spread(df), YEAR, keep=["id", "label"], **options)


def _f4(df: DataFrame, calibrate: int = 1) -> DataFrame:
    return rounded(s.forest_score(_features(df).select("id", *MODEL["meta"]["features"]), MODEL, calibrate))


def _f5(df: DataFrame) -> DataFrame:
    return wide(_features(df), "id", v=s.decision_tree_score(TREE)).withColumn("path", F.array_join("path", "; "))


def _scored(df: DataFrame) -> DataFrame:
    return s.score_signups(spread(df.drop("risk_score", "latency")), YEAR, MODEL)


def _f8(df: DataFrame) -> DataFrame:
    feats = {"tld_risk_score": F.col("risk_score"), "domain_reputation_score": F.col("id") % 100 / 100, "sequential_confidence": F.col("id") % 50 / 50, "digit_ratio": F.col("id") % 33 / 33, "plus_risk": F.col("id") % 10 / 10}
    return wide(df, "id", v=s.heuristic_lifts(F.col("id") % 77 / 77, feats)).withColumn("reasons", F.array_join("reasons", ","))


def _f13(df: DataFrame) -> DataFrame:
    now = dt.datetime(2024, 6, 1)
    e = s.Experiment("exp1", 30, dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31))
    return wide(df, "id", v=s.assign_variant(F.sha2(F.col("user_id").cast("string"), 256), e, now))


def _train_rows(df: DataFrame) -> DataFrame:
    return io.written(f.export_features_once(df, YEAR, ["id", "label"], skip_mx=True), "features")


def _t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train_rows(signups(spark, sf_dir))
    fit, held = t.stratified_split(rows, key="id", write_cuts=True)
    model = t.train_forest(fit, list(f.FEATURE_NAMES), trees=5)
    return s.forest_score(held, model).select("id", "label", "score")


def _t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train_rows(signups(spark, sf_dir))
    tree = t.train_tree(rows, list(f.FEATURE_NAMES))
    return wide(rows, "id", "label", v=s.decision_tree_score(tree)).withColumn("path", F.array_join("path", "; "))


def _t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.out_of_fold_scores(_train_rows(signups(spark, sf_dir)), list(f.FEATURE_NAMES), "id", folds=3, trees=5)


def _t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signups(spark, sf_dir).select(F.col("risk_score").alias("score"), "label", "id")
    c = t.fit_platt(rows)
    return rows.select("id", F.round(t.apply_platt(F.col("score"), c["coef"], c["intercept"]), 6).alias("calibrated"))


def _scores(df: DataFrame) -> DataFrame:
    """Scores that know something of the labels."""
    return df.select("id", "label", (F.col("risk_score") * 0.4 + F.col("label") * 0.5).alias("score"))


def _t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in t.guardrails(MODEL, _scores(signups(spark, sf_dir))).items()], "name string, value string")


def _t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train_rows(signups(spark, sf_dir))
    got = t.train_until_passed(rows, list(f.FEATURE_NAMES), trees=5, attempts=2)
    return t.importance_ranking(spark, got["model"])


def _samples(df: DataFrame) -> DataFrame:
    labelled = df.withColumn("l", t.auto_label(F.col("id") % 13 == 0, F.col("id") % 2 == 0, F.col("risk_score"), F.when(F.col("risk_score") > 0.88, "block").when(F.col("risk_score") > 0.56, "warn").otherwise("allow")))
    return labelled.select(a.email_hash(E()).alias("email_hash"), F.concat(F.lit('{"a":'), (F.col("id") % 5).cast("string"), F.lit(',"b":1}')).alias("feature_vector"), "l.label", "l.label_source", "timestamp")


def _t2(df: DataFrame) -> DataFrame:
    return t.upsert_samples(_samples(df.where("id % 2 = 0")), _samples(df.where("id % 2 = 1"))).drop("feature_vector")


def _t3(df: DataFrame) -> DataFrame:
    """A tenth of the rows is corrected; half of these corrections are of addresses that no sample has."""
    known = F.when(F.col("id") % 20 == 3, F.concat(F.lit("x"), F.trim("email"))).otherwise(F.col("email"))
    fixes = df.where("id % 10 = 3").select(a.email_hash(known).alias("email_hash"), (F.col("id") % 2).cast("int").alias("label"))
    return t.correct_labels(t.upsert_samples(_samples(df.where("id % 2 = 0")), _samples(df.where("id % 2 = 1"))), fixes, dt.datetime(2024, 3, 1)).drop("feature_vector")


def _t6(df: DataFrame) -> DataFrame:
    fit, held = t.stratified_split(df.select("id", "label"), key="id")
    return fit.withColumn("part", F.lit("fit")).union(held.withColumn("part", F.lit("held")))


def _t22(df: DataFrame) -> DataFrame:
    return t.merge_datasets({"a": (df.where("id % 2 = 0").select("id", "email", F.col("label").cast("string").alias("label")), None), "b": (df.where("id % 2 = 1").select("id", "email"), "fraud")}).select("email", "label", "source", "position")


def _bagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    rows = _train_rows(signups(spark, sf_dir))
    return rows, t.train_bagged(rows, list(f.FEATURE_NAMES), "id", trees=5)


def _t9_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _bagged(spark, sf_dir)
    return t.tree_accuracy(rows, model, "id")


def _t9_out_of_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _bagged(spark, sf_dir)
    return t.out_of_bag(rows, model, "id")


def _t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = t.random_search(_train_rows(signups(spark, sf_dir)), list(f.FEATURE_NAMES), draws=3, folds=2, trees=(5, 15), depth=(3, 6))
    return spark.createDataFrame([(i, r["trees"], r["max_depth"], r["min_leaf"], r["auc"]) for i, r in enumerate(best)], "place int, trees int, max_depth int, min_leaf int, auc double")


def _sample(df: DataFrame) -> DataFrame:
    return _features(df, limit=500, shuffle_seed=7).select("id", "position")


def _t24(df: DataFrame) -> DataFrame:
    seen = df.select(DOMAIN().alias("domain")).distinct()
    return seen.select("domain", F.explode(syn.typosquat_variants(F.col("domain"))).alias("variant"))


def _lookalikes(df: DataFrame) -> DataFrame:
    """Sign-ups whose domains had their first o replaced by a zero, against all domains seen."""
    forged = df.select("id", F.regexp_replace(DOMAIN(), "^([^o.]*)o", "$10").alias("domain"))
    return syn.lookalikes(forged, "domain", df.select(DOMAIN().alias("domain")).distinct())


def _io5(df: DataFrame) -> DataFrame:
    return io.to_log_rows(df.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("email")).alias("email"), F.array("label").alias("labels"), (F.col("label") == 1).alias("flag")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "c1_clean_address": _rows(lambda df: df.select("id", a.clean_address(F.expr(DIRTY)).alias("clean"))),
    "c2_clean_dataset": _rows(_c2),
    "c2_clean_counts": _rows(_c2_counts),
    "c3_validate_format": _rows(lambda df: df.select("id", a.validate_format(a.tidy(F.expr(ODD))).alias("ok"))),
    "c4_validate_email": _rows(lambda df: wide(df, "id", v=a.validate_email(F.expr(ODD)))),
    "c5_normalize_email": _rows(lambda df: wide(df, "id", v=a.normalize_email(E()))),
    "c7_canonical": _rows(lambda df: df.select("id", a.canonical_email(E()).alias("canonical"), a.supports_plus(DOMAIN()).alias("supports_plus"), a.equivalent(E(), F.replace(E(), F.lit("."), F.lit(""))).alias("same_without_dots"))),
    "c8_email_hash": _rows(lambda df: df.select("id", a.email_hash(E()).alias("email_hash"))),
    "c9_fingerprint": _rows(lambda df: df.select("id", a.fingerprint_hash(F.col("ip_country"), F.lit("j"), F.col("user_id"), F.lit(None), F.when(F.col("id") % 2 == 0, F.col("id"))).alias("fingerprint"))),
    "c10_mask_email": _rows(lambda df: df.select("id", a.mask_email(E()).alias("masked"))),
    "p1_sequential": _rows(lambda df: wide(df, "id", v=p.sequential(E(), YEAR))),
    "p1_numbers_between": _rows(lambda df: wide(df.withColumn("email", F.expr(BETWEEN)), "id", v=p.sequential(E(), YEAR))),
    "p3_all_dates": _rows(lambda df: wide(df.withColumn("email", F.expr(DATES)), "id", v=p.dated(E(), YEAR))),
    "n1_all_languages": _rows(lambda df: wide(spread(df).withColumn("email", F.expr(NAMES)), "id", v=n.multilingual_score(LOCAL()))),
    "n3_all_languages": _rows(lambda df: df.withColumn("email", F.expr(NAMES)).select("id", n.detect_language(LOCAL()).alias("language"))),
    "p2_sequential_family": _rows(lambda df: df.select("id", p.sequential_family(E(), YEAR).alias("family"))),
    "p3_dated": _rows(lambda df: wide(df, "id", v=p.dated(E(), YEAR))),
    "p4_year_age": _rows(lambda df: wide(df, "id", v=p.year_age((F.col("id") % 150 + 1890).cast("int"), "year", YEAR))),
    "p5_dated_family": _rows(lambda df: df.select("id", p.dated_family(E(), YEAR).alias("family"))),
    "p6_current_date": _rows(lambda df: df.select("id", p.is_current_date(LOCAL(), dt.date(2024, 10, 1)).alias("current"))),
    "p7_structure": _rows(lambda df: df.select("id", p.structure(LOCAL()).alias("structure"))),
    "p8_is_random": _rows(lambda df: df.select("id", p.is_random(LOCAL()).alias("is_random"))),
    "p9_pattern_family": _rows(lambda df: wide(spread(df), "id", v=p.pattern_family(E(), YEAR))),
    "p10_domain_type": _rows(lambda df: df.select("id", p.domain_type(DOMAIN()).alias("domain_type"))),
    "p11_plus_risk": _rows(lambda df: rounded(df.select("id", p.plus_risk(E(), (F.col("id") % 5)).alias("plus_risk")))),
    "s1_entropy": _rows(lambda df: rounded(df.select("id", x.entropy(LOCAL()).alias("entropy"), x.bigram_entropy(LOCAL()).alias("bigram_entropy")))),
    "s3_local_features": _rows(lambda df: wide(spread(df), "id", v=x.local_features(LOCAL()))),
    "s10_name_digit_hints": _rows(lambda df: wide(df, "id", v=x.name_digit_hints(LOCAL()))),
    "n1_multilingual_score": _rows(lambda df: wide(spread(df), "id", v=n.multilingual_score(LOCAL()))),
    "n2_naturalness": _rows(lambda df: wide(spread(df), "id", v=n.naturalness(F.concat(F.lit("é"), LOCAL())))),
    "n2_english": _rows(lambda df: wide(df, "id", v=n.naturalness(LOCAL(), False))),
    "n3_detect_language": _rows(lambda df: df.select("id", n.detect_language(LOCAL()).alias("language"))),
    "n4_ngram_risk": _rows(lambda df: rounded(df.select("id", n.ngram_risk(LOCAL()).alias("risk")))),
    "n5_compare_modes": _rows(lambda df: wide(df, "id", v=n.compare_modes(LOCAL()))),
    "d1_validate_domain": _rows(_d1),
    "d2_disposable_pattern": _rows(lambda df: df.select("id", d.matches_disposable_pattern(DOMAIN()).alias("matches"))),
    "d3_suspicious_reasons": _rows(lambda df: df.select("id", F.array_join(d.suspicious_reasons(DOMAIN()), "; ").alias("reasons"))),
    "d4_domain_reputation": _rows(_d4),
    "d5_tld_risk": _rows(_d5),
    "d6_tld_stats": lambda spark, sf: d.with_tld(_with_domain(signups(spark, sf))).groupBy(F.col("tld.category").alias("category")).agg(F.count("*").alias("count"), F.count(F.when(F.col("tld.is_high_risk"), 1)).alias("high_risk")),
    "d7_override_profiles": _d7,
    "d8_mx_analysis": _rows(lambda df: d.mx_analysis(_mx_records(df))),
    "d9_mx_join": _rows(_d9),
    "d10_identity": _rows(lambda df: wide(df, "id", v=i.identity(F.col("name"), LOCAL()))),
    "d11_geo": _rows(lambda df: wide(df, "id", v=i.geo(F.col("ip_country"), F.col("accept_language"), F.col("ip_country"), F.when(F.col("id") % 2 == 0, "US")))),
    "f1_feature_vector": _rows(lambda df: rounded(f.build_feature_vector(df, {"entropy_score": F.col("latency"), "local_length": F.length("email") * 5, "digit_ratio": F.col("risk_score") - 0.5, "name_in_email": F.col("label") == 1}, ["id"]))),
    "f2_export_features": _rows(lambda df: rounded(_features(df))),
    "f2_shuffled_sample": _rows(_sample),
    "f4_forest_score": _rows(_f4),
    "f5_decision_tree": _rows(_f5),
    "f7_base_risk": _rows(lambda df: rounded(df.select("id", s.base_risk(F.col("id") % 7 != 0, F.col("id") % 5 == 0, F.when(F.col("id") % 3 != 0, F.col("risk_score"))).alias("base")))),
    "f8_heuristic_lifts": _rows(_f8),
    "f9_professional_reduction": _rows(lambda df: rounded(df.select("id", s.professional_reduction(F.col("risk_score"), F.col("id") % 2 == 0, F.col("id") % 10 / 10, F.when(F.col("id") % 11 != 0, F.col("id") % 3 != 0), F.col("id") % 13 == 0, F.col("id") % 17 == 0, F.col("id") % 8 / 8, F.col("id") % 6 / 6).alias("score")))),
    "f10_decide": _rows(lambda df: df.select("id", s.decide(F.col("risk_score")).alias("decision"))),
    "f11_alerts": _rows(lambda df: rounded(s.alert_rows(_scored(df)).withColumn("reasons", F.array_join("reasons", ",")))),
    "f12_score_signups": _rows(lambda df: rounded(_scored(df).drop("feature_vector", "heuristics", "alert_reasons"))),
    "f13_assign_variant": _rows(_f13),
    "b1_plus_alias_groups": _rows(lambda df: rounded(b.plus_alias_groups(df.withColumn("domain", DOMAIN()), by=["domain"]).drop("variants"))),
    "b1_alias_members": _rows(lambda df: b.alias_members(df.withColumn("domain", DOMAIN()), by=["domain"]).select("id", "domain", "canonical")),
    "b3_sequential_members": _rows(lambda df: b.sequential_members(spread(df).withColumn("domain", DOMAIN()), YEAR, by=["domain"]).select("id", "domain", "family")),
    "b4_dated_members": _rows(lambda df: b.dated_members(spread(df).withColumn("domain", DOMAIN()), YEAR, by=["domain"]).select("id", "domain", "family", "component")),
    "b2_plus_tag_pattern": _rows(lambda df: b.plus_tag_pattern(df)),
    "b3_sequential_batch": _rows(lambda df: rounded(b.sequential_batch(df.withColumn("domain", DOMAIN()), YEAR, by=["domain"]).drop("matching"))),
    "b4_dated_batch": _rows(lambda df: rounded(b.dated_batch(df.withColumn("domain", DOMAIN()), YEAR, by=["domain"]).drop("matching", "dates"))),
    "b5_pattern_families": _rows(lambda df: b.pattern_families(spread(df), YEAR)),
    "b6_benford": _rows(lambda df: wide(b.benford(df.withColumn("hour", F.hour("timestamp")), by=["hour"]).drop("distribution"), "hour", "sample_size", "chi_square", "p_value", "follows", "confidence", "deviation", "risk", "automated", "suspicious")),
    "b8_compare_distributions": _rows(lambda df: rounded(b.compare_distributions(*[b.benford(df.where(F.col("label") == k).withColumn("day", F.to_date("timestamp")), by=["day"]) for k in (0, 1)], ["day"]))),
    "t1_auto_label": _rows(lambda df: _samples(df).drop("feature_vector")),
    "t2_upsert_samples": _rows(_t2),
    "t3_correct_labels": _rows(_t3),
    "t4_prune": _rows(lambda df: t.prune(df.select("id", "timestamp"), 14, dt.datetime(2024, 1, 31))),
    "t5_conflict_weight": _rows(lambda df: rounded(df.select("id", t.conflict_weight(F.col("latency"), F.col("risk_score")).alias("weight")))),
    "t6_split": _rows(_t6),
    "t7_forest": _t7,
    "t8_tree": _t8,
    "t9_out_of_fold": _t9,
    "t9_bootstrap": _rows(lambda df: t.bootstrap_sizes(df, "id", 10)),
    "t9_out_of_bag": _t9_out_of_bag,
    "t9_tree_accuracy": _t9_accuracy,
    "t10_platt": _t10,
    "t12_threshold_scan": _rows(lambda df: t.threshold_scan(_scores(df))),
    "t13_recommend_cli": _rows(lambda df: t.recommend_thresholds(t.threshold_scan(_scores(df)), "cli")),
    "t13_recommend_in_process": _rows(lambda df: t.recommend_thresholds(t.threshold_scan(_scores(df)), "in_process")),
    "t14_guardrails": _t14,
    "t15_evaluate": _log(lambda log: t.evaluate(log.withColumn("label", (F.col("id") % 2).cast("int")), by=["pattern_type"])),
    "t16_unlabelled_report": _log(t.unlabelled_report),
    "t17_detection_rate": _log(t.detection_rate),
    "t17_floor_percentiles": _log(t.floor_percentiles),
    "t18_conflict_metrics": _rows(lambda df: rounded(t.conflict_metrics(df.select("label", F.col("latency").alias("bigram_entropy"), F.col("risk_score").alias("domain_reputation_score"), (F.col("id") % 2).cast("int").alias("predicted"))))),
    "t19_random_search": _t19,
    "t19_roc_area": _rows(lambda df: t.roc_area(df, "risk_score").withColumn("auc", F.round("auc", 9))),
    "t20_train_until_passed": _t20,
    "t22_merge_datasets": _rows(_t22),
    "t23_synthetic": lambda spark, sf: syn.synthetic_dataset(spark, ids=signups(spark, sf)),
    "t24_typosquats": _rows(_t24),
    "t24_lookalikes": _rows(_lookalikes),
    "t25_sample_stats": _rows(lambda df: t.sample_stats(_samples(df))),
    "t25_label_by_source": _rows(lambda df: t.label_by_source(_samples(df))),
    "io3_normalize_label": _rows(lambda df: df.select("id", io.normalize_label(F.expr("CASE id % 6 WHEN 0 THEN 'Fraud' WHEN 1 THEN 'legit' WHEN 2 THEN '0.7' WHEN 3 THEN 'true' WHEN 4 THEN '0.2' END")).alias("label"))),
    "io5_log_rows": _rows(_io5),
    "io6_training_dataset": _rows(lambda df: io.build_training_dataset(_samples(df))),
    "st5_limit_hits": lambda spark, sf: jobs.limit_hits(validations(spark, sf), seconds=3600, most=2).select("id", "limited"),
}
