"""Domains: lists, reputation, TLD risk, mail exchangers. Lists are small tables, joined so that Spark can broadcast them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .tables import DISPOSABLE, FREE_PROVIDERS, KNOWN_MX, TLD_PROFILES

# Fixed values.
DISPOSABLE_PATTERN = r"temp.*mail|trash.*mail|fake.*mail|throw.*away|disposable|guerrilla|mailinator|[0-9]+minute.*mail|yopmail|maildrop|spam[0-9]+"
SKETCHY = ("mail.com", "email.com", "gmx.com", "gmx.de", "gmx.net", "yandex.com", "yandex.ru")
PRIVACY = ("proton.me", "protonmail.com", "pm.me", "tutanota.com", "tuta.com", "tuta.io")
TRUSTED = ("gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "icloud.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.jp", "aol.com")
PLATFORMS = (
    ("vercel.app", "vercel", 0.15), ("vercel.dev", "vercel", 0.15), ("herokuapp.com", "heroku", 0.15), ("onrender.com", "render", 0.15), ("netlify.app", "netlify", 0.15),
    ("pages.dev", "cloudflare-pages", 0.15), ("webflow.io", "webflow", 0.15), ("github.io", "github-pages", 0.12), ("fly.dev", "fly.io", 0.15), ("cloudfront.net", "cloudfront", 0.12))
MX_PATTERNS = (
    ("google", r"\.googlemail\.com$|\.l\.google\.com$"), ("microsoft", r"\.mail\.protection\.outlook\.com$|\.outlook\.com$|\.office365\.com$"), ("icloud", r"\.icloud\.com$|\.me\.com$"),
    ("yahoo", r"\.yahoodns\.net$|\.yahoomail\.com$"), ("zoho", r"\.zoho(mail|email)\.com$|\.mx\.zoho\.com$"), ("proton", r"\.protonmail\.ch$|\.protonmail\.com$"))
MX_PROVIDERS = ("google", "microsoft", "icloud", "yahoo", "zoho", "proton", "self_hosted", "other")


def disposable_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DISPOSABLE], "domain string")


def tld_table(spark: SparkSession) -> DataFrame:
    rows = [line.split(" ", 6) for line in TLD_PROFILES.strip().splitlines()]
    return spark.createDataFrame([(t, c, float(d), float(s), float(m), cost, text) for t, c, d, s, m, cost, text in rows], "tld string, category string, disposable_ratio double, spam_ratio double, risk_multiplier double, registration_cost string, description string")


def known_mx_table(spark: SparkSession) -> DataFrame:
    rows = [line.split() for line in KNOWN_MX.strip().splitlines()]
    return spark.createDataFrame([(d, i, f"{p} {e}.", int(ttl)) for i, (d, p, e, ttl) in enumerate(rows)], "domain string, position long, data string, ttl long")


def tidy_domain(domain: Column) -> Column:
    return F.trim(F.lower(domain))


def labels(domain: Column) -> Column:
    return F.split(domain, r"\.", -1)


def matches_disposable_pattern(domain: Column) -> Column:
    """D2."""
    return tidy_domain(domain).rlike(DISPOSABLE_PATTERN)


def validate_domain(domain: Column, listed: Column) -> Column:
    """D1 of a domain, where `listed` says whether a table of disposable ones has it: valid, is_disposable, is_free, matches_pattern, reason, length, has_valid_tld, subdomain_depth."""

    def rest(d: Column) -> Column:
        n = F.size(labels(d))
        tld_ok = F.substring_index(d, ".", -1).rlike("^[a-z]{2,}$")
        bad = F.when(F.coalesce(F.length(d), F.lit(0)) == 0, "Empty domain").when(F.length(d) > 255, "Domain too long").when(n < 2, "Invalid domain structure").when(~tld_ok, "Invalid TLD")

        def more(b: Column) -> Column:
            good = b.isNull()
            exact, pattern = good & listed, good & d.rlike(DISPOSABLE_PATTERN)
            return F.struct(
                (good & ~exact & ~pattern).alias("valid"), (exact | pattern).alias("is_disposable"), (good & d.isin(*FREE_PROVIDERS)).alias("is_free"), pattern.alias("matches_pattern"),
                F.coalesce(b, F.when(exact, "Known disposable email domain").when(pattern, "Domain matches disposable pattern")).alias("reason"), F.length(d).alias("length"), good.alias("has_valid_tld"),
                F.when(good | (b == "Invalid TLD"), n - 2).otherwise(0).alias("subdomain_depth"))

        return let(bad, more)

    return let(F.coalesce(tidy_domain(domain), F.lit("")), rest)


def with_disposable(df: DataFrame, domain: str = "domain", table: DataFrame | None = None, out: str = "listed") -> DataFrame:
    """df with whether a table of disposable domains (by default the bundled one) has its domain. The table's size decides how Spark joins it."""
    spark = df.sparkSession
    table = (disposable_table(spark) if table is None else table).select(F.trim(F.lower("domain")).alias("listed_domain")).distinct()
    joined = df.join(table, tidy_domain(F.col(domain)) == F.col("listed_domain"), "left")
    return joined.withColumn(out, F.col("listed_domain").isNotNull()).drop("listed_domain")


def suspicious_reasons(domain: Column) -> Column:
    """D3: the reasons for which a domain looks suspicious."""
    d = tidy_domain(domain)
    first = F.substring_index(d, ".", 1)
    tests = (
        (F.length(d) > 50, "Domain excessively long"), (F.size(labels(d)) - 2 > 3, "Too many subdomains"), (first.rlike("^[0-9]+$"), "Domain name is all numbers"), (F.length(first) < 3, "Domain name too short"),
        (F.regexp_count(first, F.lit("-")) > 3, "Too many hyphens in domain"), (first.rlike("^[bcdfghjklmnpqrstvwxyz]+$") & (F.length(first) > 5), "Domain appears random (no vowels)"))
    return F.array_compact(F.array(*[F.when(c, r) for c, r in tests]))


def domain_reputation(domain: Column, listed: Column) -> Column:
    """From 0 (good) to 1."""
    d = tidy_domain(domain)
    return let(validate_domain(domain, listed), lambda v: F.when(v["is_disposable"], 1.0).when(d.isin(*SKETCHY), 0.6).when(d.isin(*PRIVACY), 0.3).when(d.isin(*TRUSTED), 0.1).otherwise(
        F.least(0.3 + F.lit(0.1) * F.size(suspicious_reasons(domain)) + F.when(v["subdomain_depth"] > 2, F.lit(0.1) * v["subdomain_depth"]).otherwise(0.0), F.lit(1.0))))


def tld_risk(domain: Column, multiplier: Column, category: Column) -> Column:
    """D5 and D6 of a domain, given its TLD's profile (null where it has none): tld, risk_score, category, registrable_domain, subdomain_depth, platform, is_high_risk, is_trusted."""

    def rest(d: Column) -> Column:
        parts = labels(d)
        n = F.size(parts)
        platform, boost, size = F.lit(None).cast("string"), F.lit(0.0), F.lit(1)
        for suffix, name, more in PLATFORMS:  # no suffix ends with another
            here = (d == suffix) | d.endswith("." + suffix)
            platform, boost, size = F.when(here, name).otherwise(platform), F.when(here, more).otherwise(boost), F.when(here, suffix.count(".") + 1).otherwise(size)
        registrable = F.array_join(F.slice(parts, F.greatest(n - size, F.lit(1)) , F.least(size + 1, n)), ".")
        depth = F.greatest(n - size - 1, F.lit(0))
        hosted = platform.isNotNull()
        base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (multiplier - 0.2) / 2.8))
        score = F.when(multiplier.isNull(), F.when(hosted, F.least(F.lit(1.0), 0.25 + boost)).otherwise(0.15)).otherwise(F.when(hosted, F.least(F.lit(1.0), base + boost + depth * F.lit(0.02))).otherwise(base))
        kind = F.coalesce(category, F.lit("unknown"))
        return F.struct(
            F.element_at(parts, -1).alias("tld"), score.alias("risk_score"), kind.alias("category"), registrable.alias("registrable_domain"), depth.alias("subdomain_depth"), platform.alias("platform"),
            ((score > 0.7) | (kind == "high_risk")).alias("is_high_risk"), (kind == "trusted").alias("is_trusted"))

    return let(F.lower(domain), rest)


def with_tld(df: DataFrame, domain: str = "domain", profiles: DataFrame | None = None, out: str = "tld") -> DataFrame:
    """df with D5 of its domain, by a join with the table of TLD profiles."""
    profiles = (tld_table(df.sparkSession) if profiles is None else profiles).select(F.col("tld").alias("profile_tld"), F.col("risk_multiplier").alias("profile_multiplier"), F.col("category").alias("profile_category"))
    joined = df.join(profiles, F.substring_index(F.lower(F.col(domain)), ".", -1) == F.col("profile_tld"), "left")
    return joined.withColumn(out, tld_risk(F.col(domain), F.col("profile_multiplier"), F.col("profile_category"))).drop("profile_tld", "profile_multiplier", "profile_category")


def tld_stats(profiles: DataFrame) -> DataFrame:
    """How many TLDs each category has."""
    return profiles.groupBy("category").agg(F.count("*").alias("count"))


def high_risk_tlds(profiles: DataFrame) -> DataFrame:
    return profiles.where("category = 'high_risk'").select("tld")


def override_profiles(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """Profiles with the fields of `updates` (by tld) where they aren't null. An unknown TLD is an error."""
    unknown = updates.join(profiles, "tld", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown TLD: {unknown[0].tld}")
    new = updates.select("tld", *[F.col(c).alias(f"new_{c}") for c in updates.columns if c != "tld"])
    joined = profiles.join(new, "tld", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in updates.columns and c != "tld" else F.col(c) for c in profiles.columns])


def mx_provider(exchange: Column, domain: Column) -> Column:
    host = F.regexp_replace(F.lower(exchange), r"\.$", "")
    out = F.when(host.endswith(F.lower(domain)), "self_hosted")
    for name, pattern in MX_PATTERNS:
        out = out.when(host.rlike(pattern), name)
    return out.otherwise("other")


def mx_analysis(records: DataFrame) -> DataFrame:
    """A row for each domain of records (domain, position, data, ttl), data being "preference exchange.".

    The primary provider is the one that first reaches the highest count; ttl is the last record's. Records that can't
    be parsed are left out; a domain without others keeps a row with no records.
    """
    parsed = records.select("domain", "position", "ttl", F.regexp_extract("data", r"^([0-9]+)\s+(.+)$", 1).alias("preference"), F.regexp_replace(F.regexp_extract("data", r"^([0-9]+)\s+(.+)$", 2), r"\.$", "").alias("exchange"))
    parsed = parsed.withColumn("provider", F.when(F.col("preference") != "", mx_provider(F.col("exchange"), F.col("domain"))))
    per = parsed.groupBy("domain", "provider").agg(F.count("*").alias("hits"), F.max("position").alias("reached"), F.max_by("ttl", "position").alias("ttl"))
    real = F.col("provider").isNotNull()
    hit = lambda p: F.coalesce(F.sum(F.when(F.col("provider") == p, F.col("hits"))), F.lit(0)).alias(f"mx_{p}")
    return per.groupBy("domain").agg(
        F.coalesce(F.sum(F.when(real, F.col("hits"))), F.lit(0)).alias("mx_record_count"), *[hit(p) for p in MX_PROVIDERS],
        F.min_by("provider", F.when(real, F.struct(-F.col("hits"), "reached"))).alias("mx_primary_provider"), F.max_by("ttl", F.when(real, F.col("reached"))).alias("mx_ttl")
    ).withColumn("mx_has_records", F.col("mx_record_count") > 0)


def with_mx(df: DataFrame, domain: str = "domain", resolved: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Df with mx_* columns: a well-known domain's, else those of `resolved` (mx_analysis of a records table); null without either."""
    spark = df.sparkSession
    table = mx_analysis(known_mx_table(spark) if known is None else known).withColumn("rank", F.lit(0))
    if resolved is not None:
        table = table.unionByName(resolved.join(table.select("domain"), "domain", "left_anti").withColumn("rank", F.lit(1)))
    return df.join(table.drop("rank").withColumnRenamed("domain", "mx_domain"), F.lower(F.col(domain)) == F.col("mx_domain"), "left").drop("mx_domain")
