"""SQL for the whole feature matrix and for end-to-end scoring, joined from the parts' SQL over addresses as their provider reads them."""

from __future__ import annotations

import json

from ..functions import tables
from ..functions.domains import MX_PROVIDERS
from ..operators.features import FEATURES
from ..sources.fixtures import WITH_SIGNUPS
from . import signup_oracles as o
from .signup_queries import MODEL, ODD

NORMAL = f"{WITH_SIGNUPS}, s8 AS (SELECT *, lower(trim(email)) AS e, split_part(lower(trim(email)), '@', 1) AS l, split_part(lower(trim(email)), '@', 2) AS d FROM signups), s AS (SELECT * EXCLUDE (l), {o.DOTLESS} AS l FROM s8)"
CHECKED = o.ODDS.replace(f"lower(trim({ODD}))", "lower(trim(email))")
PREFIXED = NORMAL + ", s0 AS (SELECT id, l AS l0 FROM s), sp AS (SELECT *, regexp_replace(regexp_replace(l0, '[0-9._-]+$', ''), '[^a-zA-Z]', '', 'g') AS l FROM s0)"
DISPOSABLE = f"({o.LISTED} OR regexp_matches(d, '{o.DISPOSABLE_PATTERN}'))"


def _body(name: str) -> str:
    """A registered statement without the table it starts from."""
    return o.ORACLE_SQL[name]


PARTS = {
    "sq": f"{NORMAL} {o.SEQ} SELECT id, c AS sequential_confidence FROM seq",
    "ft": f"{NORMAL} {o.FEATS} SELECT id, len(l) AS local_length, digit_ratio, pronounceability, vowel_ratio, max_consonant_run AS max_consonant_cluster, repeated_char_ratio, syllables AS syllable_estimate, impossible_clusters AS impossible_cluster_count, "
          f"CAST(has_word_boundaries AS INT) AS has_word_boundaries, segment_count, avg_segment_length, segments_without_vowels_ratio, unique_char_ratio, vowel_gap_ratio, max_digit_run, {o._entropy(o.PAIRS)} AS bigram_entropy FROM f5",
    "im": f"{NORMAL} {o.IDENTITY} SELECT id, similarity AS name_similarity_score, overlap AS name_token_overlap, CAST(found > 0 AS INT) AS name_in_email FROM idn",
    "ng": f"{NORMAL} {o.NGRAM} SELECT id, b2 AS ngram_bigram_score, b3 AS ngram_trigram_score, o AS ngram_overall_score, conf AS ngram_confidence, CAST(nat AS INT) AS ngram_is_natural, "
          "CASE WHEN len(l) < 3 THEN 0.1 ELSE least(greatest(0.0, 1 - o / CASE WHEN len(l) < 5 THEN 0.3 ELSE 0.4 END) * conf, 1.0) END AS ngram_risk_score FROM g",
    "pf": f"{PREFIXED} {o.NGRAM.replace('FROM s)', 'FROM sp)')} SELECT id, CAST(coalesce(TRY_CAST(regexp_extract(l0, '([0-9][0-9][0-9][0-9])$', 1) AS INT) BETWEEN 1940 AND 2025, false) AS INT) AS has_year_suffix, CASE WHEN len(l) >= 2 THEN o ELSE 0.0 END AS alpha_prefix_naturalness, "
          "CASE WHEN regexp_matches(l0, '[0-9]') THEN len(regexp_extract(l0, '^[^0-9]*')) / len(l0) ELSE 0.5 END AS digit_position_ratio FROM g",
    "td": f"{NORMAL} {o.TLD} SELECT id, score AS tld_risk_score FROM tl",
    "rp": _body("d4_domain_reputation").replace("SELECT id, round(", "SELECT id, (").replace(", 6) AS reputation", ") AS domain_reputation_score"),
    "vl": f"{CHECKED}, v AS (SELECT *, CASE WHEN ok THEN least({o._entropy('(string_split(l, ' + chr(39) * 2 + '))')} / 6.6, 1.0) ELSE 0.0 END AS en FROM ok) SELECT id, ok AND en <= 0.85 AND len(l) >= 3 AS valid, "
          "CASE WHEN NOT ok THEN 'Invalid email format' WHEN en > 0.85 THEN 'Suspicious random string pattern detected' WHEN len(l) < 3 THEN 'Email local part too short' END AS invalid_reason, en AS entropy_score FROM v",
    "rest": f"{NORMAL.replace(', s AS (SELECT * EXCLUDE (l), ' + o.DOTLESS + ' AS l FROM s8)', '')} SELECT s8.id, s8.d AS domain_, l AS local_, CASE WHEN contains(l, '+') THEN CASE WHEN regexp_matches({o.TAG}, '{o.SUSPICIOUS}') THEN 0.5 ELSE 0.2 END ELSE 0.0 END AS plus_risk, "
            f"s8.d IN {o._in(tables.FREE_PROVIDERS)} AS free, {DISPOSABLE.replace('d IN', 's8.d IN').replace('(d,', '(s8.d,')} AS disposable, coalesce(ip_country <> CASE WHEN contains(split_part(accept_language, ',', 1), '-') THEN upper(string_split(split_part(accept_language, ',', 1), '-')[-1]) END, false) AS language, "
            f"n AS mx_n, p AS mx_p FROM s8 LEFT JOIN {o.KNOWN_MX} ON known.d = s8.d",
}


def matrix(mx_of_disposable: bool) -> str:
    """Common table expressions up to `made`: sign-ups, their 48 features within their limits, and what else the parts found."""
    looked = "mx_n" if mx_of_disposable else "CASE WHEN NOT disposable THEN mx_n END"
    own = {
        "geo_language_mismatch": "CAST(language AS INT)", "geo_timezone_mismatch": "0", "geo_anomaly_score": "CASE WHEN language THEN 0.6 ELSE 0.0 END", "mx_has_records": f"CASE WHEN {looked} > 0 THEN 1 END", "mx_record_count": looked,
        **{f"mx_provider_{p}": f"CASE WHEN {looked} > 0 AND mx_p = '{p}' THEN 1 ELSE 0 END" for p in MX_PROVIDERS}, "provider_is_free": "CAST(free AS INT)", "provider_is_disposable": "CAST(disposable AS INT)"}
    columns = ", ".join(f"CAST(coalesce(least(greatest({own.get(n, n)}, {low}), {high}), {fallback}) AS DOUBLE) AS {n}" for n, low, high, fallback in FEATURES)
    tables_ = "".join(f", {name} AS ({sql})" for name, sql in PARTS.items())
    joins = " ".join(f"JOIN {name} USING (id)" for name in PARTS)
    extra = f"domain_, local_, valid, invalid_reason, free, disposable, language, {looked} AS mx_found_n, mx_p, name_similarity_score AS similarity"
    return f"{WITH_SIGNUPS}{tables_}, made AS (SELECT signups.*, {extra}, {columns} FROM signups {joins})"


# The rules' features, each with its thresholds, the scores they lift to and the reasons.
RULES = tuple((name, rules) for name, (_, rules) in zip(("tld_risk_score", "domain_reputation_score", "sequential_confidence", "digit_ratio", "plus_risk"), o.RULES, strict=True))


def _lifts() -> str:
    out, at = "", "x0"
    for k, (feature, rules) in enumerate(RULES):
        goal = " ".join(f"WHEN {feature} >= {t} THEN {g}" for t, g, _ in rules)
        out += f", x{k + 1} AS (SELECT * REPLACE (CASE WHEN valid AND NOT disposable THEN greatest(x, coalesce(CASE {goal} END, x)) ELSE x END AS x) FROM {at})"
        at = f"x{k + 1}"
    return out


SCORED = f"""{matrix(False)},
x0 AS (SELECT *, CAST(CASE WHEN NOT valid THEN 0.8 WHEN disposable THEN 0.95 ELSE 1 / (1 + exp(2.0 - 4.0 * ((CASE WHEN digit_ratio > 0.3 THEN 0.9 WHEN tld_risk_score > 0.5 THEN 0.7 ELSE 0.1 END + CASE WHEN entropy_score > 0.45 THEN 0.6 ELSE 0.2 END) / 2))) END AS DOUBLE) AS x FROM made){_lifts()},
sc0 AS (SELECT *, CASE WHEN valid AND NOT disposable AND x > 0.56 AND ngram_is_natural = 1 AND alpha_prefix_naturalness > 0.4 AND mx_has_records = 1 AND provider_is_free = 0 AND sequential_confidence < 0.3 AND digit_ratio < 0.5 THEN x * 0.5 ELSE x END AS score FROM x{len(RULES)}),
fm AS ({_body("p9_pattern_family")}),
scored AS (SELECT sc0.*, CASE WHEN score > 0.88 THEN 'block' WHEN score > 0.56 THEN 'warn' ELSE 'allow' END AS decision, fm.family, fm.type, fm.confidence FROM sc0 JOIN fm USING (id))"""

REASON = "CASE WHEN decision = 'block' THEN CASE WHEN NOT valid THEN invalid_reason WHEN disposable THEN 'disposable_domain' ELSE 'random_forest' END END"
MX_FOUND = "CASE WHEN mx_found_n > 0 THEN 1 END"
MX_PRIMARY = "CASE WHEN mx_found_n > 0 THEN mx_p END"
ALERTS = (
    f"{SCORED}, al AS (SELECT *, array_to_string([x for x in [CASE WHEN length(name) > 0 AND similarity < 0.2 THEN 'low_identity_similarity' END, CASE WHEN language THEN 'geo_language_mismatch' END] if x IS NOT NULL], ',') AS reasons FROM scored) "
    f"SELECT CASE WHEN length(local_) > 3 THEN substr(email, 1, 3) || '***' || substr(email, instr(email, '@')) ELSE email END AS email, round(score, 6) AS risk_score, decision, reasons, round(name_similarity_score, 6) AS identity_similarity, "
    f"CAST(language AS INT) AS geo_language_mismatch, CAST(0 AS INT) AS geo_timezone_mismatch, {MX_PRIMARY} AS mx_provider, timestamp FROM al WHERE score > 0.56 AND reasons <> ''")
LABEL = "CASE WHEN disposable THEN 1 WHEN free AND score < 0.2 THEN 0 WHEN decision = 'block' THEN 1 WHEN decision = 'allow' THEN 0 WHEN score >= 0.5 THEN 1 ELSE 0 END"

ORACLE_SQL = {
    "f2_export_features": f"{matrix(True)} SELECT id, label, {', '.join(f'round({n}, 6) AS {n}' for n, *_ in FEATURES)} FROM made",
    "f12_score_signups": (
        f"{SCORED} SELECT id, timestamp, user_id, email, name, label, ip_country, accept_language, decision, round(score, 6) AS risk_score, {REASON} AS block_reason, sha256(lower(trim(email))) AS email_hash, local_ AS email_local_part, domain_ AS domain, "
        "type AS pattern_type, family AS pattern_family, round(confidence, 6) AS pattern_confidence, CAST(disposable AS INT) AS is_disposable, CAST(free AS INT) AS is_free_provider, round(entropy_score, 6) AS entropy_score, round(tld_risk_score, 6) AS tld_risk_score, "
        "round(domain_reputation_score, 6) AS domain_reputation_score, round(name_similarity_score, 6) AS name_similarity_score, CAST(language AS INT) AS geo_language_mismatch_flag, CAST(0 AS INT) AS geo_timezone_mismatch_flag, "
        f"{MX_FOUND} AS mx_found, {MX_PRIMARY} AS mx_primary_provider, type IN ('sequential', 'dated', 'plus-addressing') AND confidence >= 0.5 AS pattern_detected, type = 'random' AS out_of_distribution, valid AND NOT disposable AS valid FROM scored"),
    "f11_alerts": ALERTS,
    "st1_score_stream": f"{SCORED} SELECT id, email, decision, round(score, 6) AS risk_score, {REASON} AS block_reason FROM scored",
    "st2_samples_stream": (
        f"{SCORED}, sm AS (SELECT sha256(lower(trim(email))) AS email_hash, CAST({LABEL} AS INT) AS label, CASE WHEN disposable THEN 'known_disposable' WHEN free AND score < 0.2 THEN 'known_provider' ELSE 'model' END AS label_source, round(score, 6) AS risk_score, decision, '1' AS model_version, timestamp FROM scored), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY email_hash ORDER BY timestamp DESC, label DESC) AS k FROM sm) SELECT * EXCLUDE (k) FROM rk WHERE k = 1"),
    "st6_alert_stream": ALERTS,
    "t14_guardrails": (
        f"SELECT unnest(['warn', 'block', 'passed', 'failures', 'bytes']) AS name, unnest([CAST(warn AS VARCHAR), CAST(block AS VARCHAR), 'True', '[]', '{len(json.dumps(MODEL, separators=(',', ':')).encode())}']) AS value FROM ({_body('t13_recommend_in_process')}) WHERE warn IS NOT NULL"),
}
