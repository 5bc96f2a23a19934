"""Address cleaning: column functions from an address to its parts and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

# Fixed values.
PLUS_PROVIDERS = ("gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "icloud.com", "me.com", "protonmail.com", "proton.me", "fastmail.com")
DOT_PROVIDERS = ("gmail.com", "googlemail.com")
SUSPICIOUS_TAG = r"^[0-9]+$|test|spam|temp|fake|trash|junk|disposable|throwaway|burner|trial"
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
FORMAT = rf"^[\p{{L}}\p{{N}}!#$%&'*+/=?^_`{{|}}~.-]+@{LABEL}(?:\.{LABEL})*$"


def tidy(email: Column) -> Column:
    """Lower case, without white space around."""
    return F.btrim(F.lower(email), F.lit(" \t\n\x0b\x0c\r ﻿"))


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def domain_part(email: Column) -> Column:
    """What stands between the first @ and the next; null without an @."""
    return F.try_element_at(F.split(email, "@"), F.lit(2))


def clean_address(email: Column) -> Column:
    """An address free of mailto:, brackets, quotes, white space and trailing marks; null unless it has one @ with both sides and a dot in the domain."""
    x = F.regexp_replace(tidy(email), "mailto:", "")
    x = F.regexp_replace(x, r"^<+|>+$", "")
    x = F.regexp_replace(x, r"""["'()\[\]{}]|\s+""", "")
    x = F.regexp_replace(x, r"[.,;]+$", "")
    x = F.regexp_replace(x, r"\.{2,}", ".")
    return F.when(x.rlike(r"^[^@]+@[^@]*\.[^@]*$"), x)


def clean_dataset(df: DataFrame, email: str = "email", label: str = "label", order: str = "id", source: str = "clean") -> tuple[DataFrame, DataFrame]:
    """The first row of each clean address, and one row of counts (kept, duplicates, invalid).

    Labels become `fraud` where they begin so, else `legit`. Without valid rows the first frame is empty.
    """
    cleaned = df.withColumn(email, clean_address(F.col(email)))
    valid = cleaned.where(F.col(email).isNotNull())
    first = valid.withColumn("n", F.row_number().over(W.partitionBy(email).orderBy(order))).where("n = 1").drop("n")
    kept = first.withColumn(label, F.when(F.lower(F.col(label).cast("string")).startswith("fraud"), "fraud").otherwise("legit")).withColumn("source", F.lit(source))
    counts = cleaned.agg(F.count_distinct(email).alias("kept"), (F.count(email) - F.count_distinct(email)).alias("duplicates"), F.count(F.when(F.col(email).isNull(), 1)).alias("invalid"))
    return kept, counts


def validate_format(email: Column) -> Column:
    """Whether the address has the form of one: local part up to 64, domain up to 255 with a dot, last label 2 or more."""
    domain = domain_part(email)
    last = F.substring_index(domain, ".", -1)
    ok = email.rlike(FORMAT) & (F.length(local_part(email)) <= 64) & (F.length(domain) <= 255) & domain.contains(".") & (F.length(last) >= 2)
    return F.coalesce(ok, F.lit(False))


def validate_email(email: Column) -> Column:
    """C4: valid, reason, format_valid, entropy and local_length of an address."""
    from .lexical import entropy

    def rest(x: Column) -> Column:
        ok = validate_format(x)
        return let(F.struct(ok.alias("ok"), F.when(ok, entropy(local_part(x))).otherwise(0.0).alias("e"), F.when(ok, F.length(local_part(x))).otherwise(0).alias("n")), lambda v: F.struct(
            (v["ok"] & (v["e"] <= 0.85) & (v["n"] >= 3)).alias("valid"),
            F.when(~v["ok"], "Invalid email format").when(v["e"] > 0.85, "Suspicious random string pattern detected").when(v["n"] < 3, "Email local part too short").alias("reason"),
            v["ok"].alias("format_valid"), v["e"].alias("entropy"), v["n"].alias("local_length")))

    return let(tidy(email), rest)


def suspicious_plus_tag(tag: Column) -> Column:
    """C6."""
    return F.coalesce(F.lower(tag).rlike(SUSPICIOUS_TAG), F.lit(False))


def normalize_email(email: Column) -> Column:
    """Original, normalized, has_plus, plus_tag, provider_normalized, dots_removed, suspicious_tag."""

    def rest(x: Column) -> Column:
        local, domain = local_part(x), domain_part(x)
        whole = (F.length(local) > 0) & (F.coalesce(F.length(domain), F.lit(0)) > 0)
        plus = F.locate("+", local)
        has = whole & (plus > 0)
        base = F.when(has, F.substring(local, F.lit(1), plus - 1)).otherwise(local)
        tag = F.when(has, F.substring(local, plus + 1, F.length(local)))
        bare = F.when(domain.isin(*DOT_PROVIDERS), F.replace(base, F.lit("."), F.lit(""))).otherwise(base)
        join = lambda part: F.when(whole, F.concat(part, F.lit("@"), domain)).otherwise(x)
        return F.struct(
            x.alias("original"), join(base).alias("normalized"), has.alias("has_plus"), tag.alias("plus_tag"), join(bare).alias("provider_normalized"),
            F.when(whole, F.length(base) - F.length(bare)).otherwise(0).alias("dots_removed"), suspicious_plus_tag(tag).alias("suspicious_tag"))

    return let(tidy(email), rest)


def canonical_email(email: Column) -> Column:
    """The address that all its aliases share."""
    return normalize_email(email)["provider_normalized"]


def equivalent(a: Column, b: Column) -> Column:
    return canonical_email(a) == canonical_email(b)


def supports_plus(domain: Column) -> Column:
    return F.lower(domain).isin(*PLUS_PROVIDERS)


def email_hash(email: Column, trim: bool = True) -> Column:
    """SHA-256 of the address in lower case."""
    return F.sha2(F.trim(F.lower(email)) if trim else F.lower(email), 256)


def fingerprint_hash(ip: Column, ja4: Column, asn: Column, device: Column, bot_score: Column) -> Column:
    """SHA-256 of the parts joined by colons; missing text counts as '', missing numbers as 0."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (ip, ja4)]
    number = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return F.sha2(F.concat_ws(":", *text, number(asn), F.coalesce(device.cast("string"), F.lit("")), number(bot_score)), 256)


def mask_email(email: Column) -> Column:
    """The first three characters and the domain."""
    return F.regexp_replace(email, r"^(.{3}).+(@.+)$", "$1***$2")
