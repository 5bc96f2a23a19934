"""The 48-column feature matrix of sign-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address as a
from ..functions import domains as d
from ..functions import identity as i
from ..functions import lexical, ngrams, patterns
from .hashed import numbered

#: Name, least, most, and the value for null, NaN or infinite ones.
FEATURES = (
    ("sequential_confidence", 0, 1, 0), ("plus_risk", 0, 1, 0), ("local_length", 0, 128, 0), ("digit_ratio", 0, 1, 0), ("name_similarity_score", 0, 1, 0), ("name_token_overlap", 0, 1, 0), ("name_in_email", 0, 1, 0),
    ("geo_language_mismatch", 0, 1, 0), ("geo_timezone_mismatch", 0, 1, 0), ("geo_anomaly_score", 0, 1, 0), ("mx_has_records", 0, 1, 0), ("mx_record_count", 0, 32, 0),
    *((f"mx_provider_{p}", 0, 1, 0) for p in d.MX_PROVIDERS), ("provider_is_free", 0, 1, 0), ("provider_is_disposable", 0, 1, 0), ("tld_risk_score", 0, 1, 0), ("domain_reputation_score", 0, 1, 0),
    ("entropy_score", 0, 16, 0), ("has_year_suffix", 0, 1, 0), ("alpha_prefix_naturalness", 0, 1, 0), ("digit_position_ratio", 0, 1, 0.5), ("pronounceability", 0, 1, 0), ("vowel_ratio", 0, 1, 0),
    ("max_consonant_cluster", 0, 64, 0), ("repeated_char_ratio", 0, 1, 0), ("syllable_estimate", 0, 20, 0), ("impossible_cluster_count", 0, 20, 0), ("has_word_boundaries", 0, 1, 0), ("segment_count", 0, 32, 0),
    ("avg_segment_length", 0, 64, 0), ("segments_without_vowels_ratio", 0, 1, 0), ("unique_char_ratio", 0, 1, 0), ("vowel_gap_ratio", 0, 1, 0), ("max_digit_run", 0, 64, 0), ("bigram_entropy", 0, 16, 0),
    ("ngram_bigram_score", 0, 1, 0), ("ngram_trigram_score", 0, 1, 0), ("ngram_overall_score", 0, 1, 0), ("ngram_confidence", 0, 1, 0), ("ngram_risk_score", 0, 1, 0), ("ngram_is_natural", 0, 1, 0))
FEATURE_NAMES = tuple(n for n, *_ in FEATURES)


def sanitize(value: Column, low: float, high: float, fallback: float) -> Column:
    x = value.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))).otherwise(float(fallback))


def build_feature_vector(df: DataFrame, sources: dict[str, Column], keep: list[str]) -> DataFrame:
    """df's `keep` columns and the 48 features as doubles, from columns by feature name; missing ones get their fallback."""
    return df.select(*keep, *[sanitize(sources.get(n, F.lit(None)), low, high, fallback).alias(n) for n, low, high, fallback in FEATURES])


def signals(df: DataFrame, as_of_year: int, email: str = "email", name: str | None = "name", country: str | None = "ip_country", language: str | None = "accept_language", client_tz: str | None = None, edge_tz: str | None = None,
            disposable: DataFrame | None = None, profiles: DataFrame | None = None, mx: DataFrame | None = None, skip_mx: bool = False) -> DataFrame:
    """df with what features and scoring need, in struct columns s_*. Lists are joined as tables, so their size decides
    how; the work goes in several selects, which keeps generated code small."""
    col = lambda c: F.col(c).cast("string") if c and c in df.columns else F.lit(None).cast("string")
    out = df.withColumns({"s_check": a.validate_email(F.col(email)), "s_norm": a.normalize_email(F.col(email))})
    out = out.withColumns({"s_local": F.coalesce(a.local_part(F.col("s_norm.provider_normalized")), F.lit("")), "s_domain": a.domain_part(F.col("s_norm.provider_normalized"))})
    out = d.with_tld(d.with_disposable(out, "s_domain", disposable, "s_listed"), "s_domain", profiles, "s_tld")
    if not skip_mx:
        out = d.with_mx(out, "s_domain", mx)
    else:
        out = out.withColumns({"mx_has_records": F.lit(None).cast("boolean"), "mx_record_count": F.lit(None).cast("long"), "mx_primary_provider": F.lit(None).cast("string"), **{f"mx_{p}": F.lit(None).cast("long") for p in d.MX_PROVIDERS}})
    out = out.withColumns({
        "s_dom": d.validate_domain(F.col("s_domain"), F.col("s_listed")), "s_reputation": F.when(F.length("s_domain") > 0, d.domain_reputation(F.col("s_domain"), F.col("s_listed"))).otherwise(0.0),
        "s_seq": patterns.sequential(F.col("s_norm.provider_normalized"), as_of_year), "s_plus": patterns.plus_risk(F.col(email))})
    out = ngrams.with_naturalness(lexical.with_local_features(out, F.col("s_local"), "s_lex"), F.col("s_local"), "s_ngram")
    out = out.withColumn("s_hints", lexical.name_digit_hints(F.col("s_local")))
    out = out.withColumn("s_lcs", i.longest_common_subsequence(F.when(F.length("s_local") > 0, F.array_join(i.name_tokens(col(name)), "")), ngrams.letters(F.col("s_local")))) if name in df.columns else out.withColumn("s_lcs", F.lit(0))
    return out.withColumns({
        "s_ngram_risk": ngrams.ngram_risk(F.col("s_local"), F.col("s_ngram")), "s_identity": i.identity(col(name), F.col("s_local"), F.col("s_lcs")),
        "s_geo": i.geo(col(country), col(language), col(client_tz), col(edge_tz))})


def feature_sources() -> dict[str, Column]:
    """Where each feature is in the output of signals()."""
    c = F.col
    same = {f"mx_provider_{p}": c(f"mx_{p}") > 0 for p in d.MX_PROVIDERS}
    lex = {n: c(f"s_lex.{n}") for n in ("digit_ratio", "pronounceability", "vowel_ratio", "repeated_char_ratio", "has_word_boundaries", "segment_count", "avg_segment_length", "segments_without_vowels_ratio", "unique_char_ratio", "vowel_gap_ratio", "max_digit_run", "bigram_entropy")}
    return {
        **same, **lex, "sequential_confidence": c("s_seq.confidence"), "plus_risk": c("s_plus"), "local_length": c("s_lex.length"), "name_similarity_score": c("s_identity.similarity"),
        "name_token_overlap": c("s_identity.token_overlap"), "name_in_email": c("s_identity.name_in_email"), "geo_language_mismatch": c("s_geo.language_mismatch"), "geo_timezone_mismatch": c("s_geo.timezone_mismatch"),
        "geo_anomaly_score": c("s_geo.anomaly_score"), "mx_has_records": c("mx_has_records"), "mx_record_count": c("mx_record_count"), "provider_is_free": c("s_dom.is_free"), "provider_is_disposable": c("s_dom.is_disposable"),
        "tld_risk_score": F.when(F.length("s_domain") > 0, c("s_tld.risk_score")), "domain_reputation_score": c("s_reputation"), "entropy_score": c("s_check.entropy"), "has_year_suffix": c("s_hints.has_year_suffix"),
        "alpha_prefix_naturalness": c("s_hints.alpha_prefix_naturalness"), "digit_position_ratio": c("s_hints.digit_position_ratio"), "max_consonant_cluster": c("s_lex.max_consonant_run"),
        "syllable_estimate": c("s_lex.syllables"), "impossible_cluster_count": c("s_lex.impossible_clusters"), "ngram_bigram_score": c("s_ngram.bigram_score"), "ngram_trigram_score": c("s_ngram.trigram_score"),
        "ngram_overall_score": c("s_ngram.overall_score"), "ngram_confidence": c("s_ngram.confidence"), "ngram_risk_score": c("s_ngram_risk"), "ngram_is_natural": c("s_ngram.is_natural")}


def export_features(df: DataFrame, as_of_year: int, email: str = "email", keep: list[str] | None = None, limit: int | None = None, shuffle_seed: int | None = None, skip_mx: bool = False, timezone: str | None = None, **options) -> DataFrame:
    """the feature matrix of the rows that have an address.

    With a seed each row has its `position`, from 0, in a random order that hangs on the seed, the address and the kept columns alone, and
    `limit` takes the first ones; without, `limit` takes any.
    """
    rows = df.where(F.length(F.trim(F.col(email))) > 0)
    kept = keep if keep is not None else [email]
    if shuffle_seed is not None:
        rows = numbered(rows, shuffle_seed, list(dict.fromkeys([email, *kept])), name="position")
        rows = rows if limit is None else rows.where(F.col("position") < limit)
        kept = [*kept, "position"]
    elif limit is not None:
        rows = rows.limit(limit)
    made = signals(rows, as_of_year, email, client_tz=timezone, edge_tz=timezone, skip_mx=skip_mx, **options)
    return build_feature_vector(made, feature_sources(), kept)


#: Lists of the rows that share an address go by so many, so that a frequent one isn't one list.
PARTS = 16


def export_features_once(df: DataFrame, as_of_year: int, keep: list[str], inputs: tuple[str, ...] = ("email", "name", "ip_country", "accept_language"), **options) -> DataFrame:
    """export_features of all rows, where rows that agree in all inputs are worked out together; their kept columns travel as a list. Row order is open."""
    part = F.pmod(F.xxhash64(*keep), F.lit(PARTS))
    groups = df.groupBy(*inputs, part.alias("_part")).agg(F.collect_list(F.struct(*keep)).alias("_rows"))
    made = export_features(groups, as_of_year, keep=["_rows"], **options)
    return made.select(F.explode("_rows").alias("_row"), *FEATURE_NAMES).select(*[F.col(f"_row.{c}").alias(c) for c in keep], *FEATURE_NAMES)


def feature_alignment(columns: list[str], model_features: list[str], most: float = 0.2) -> dict:
    """which features of a model a frame lacks, which it has beside them, and whether more than `most` are missing."""
    missing = [f for f in model_features if f not in columns]
    extra = [c for c in columns if c not in set(model_features)]
    ratio = len(missing) / len(model_features) if model_features else 0.0
    return {"missing": missing, "extra": extra, "missing_ratio": ratio, "ok": ratio <= most}
