"""Statistics of local parts: character classes, runs, segments, syllables, entropy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clamp, in_steps, let
from .ngrams import naturalness

# Consonant clusters that words have.
CLUSTERS = ("sch", "schw", "shr", "spl", "spr", "scr", "str", "scl", "thr", "phr", "chr", "ght", "tch", "nch", "ngh", "nth", "ndr", "ngr")
LAST_BIRTH_YEAR = 2025


def _bits(items: Column) -> Column:
    """Shannon entropy of an array's items, in bits; 0 for an empty one."""
    return let(items, lambda xs: F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda a, x: let(
        F.size(F.filter(xs, lambda y: y == x)) / F.size(xs), lambda p: a - p * F.log2(p))))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Bits of the characters over 6.6, 1 at most; '' gives 0."""
    return F.least(_bits(chars(text)) / 6.6, F.lit(1.0))


def grams(text: Column, n: int) -> Column:
    """All windows of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def bigram_entropy(text: Column) -> Column:
    """Bits of adjacent pairs, in lower case; under two characters 0."""
    return _bits(grams(F.lower(text), 2))


def marked(lower: Column) -> Column:
    """S3: the text with y and w as V where they count as vowels: y between no vowels, w after one."""
    return F.regexp_replace(F.regexp_replace(lower, "(?<![aeiou])y(?![aeiou])", "V"), "(?<=[aeiou])w", "V")


def classes(mark: Column) -> Column:
    """The class of each character of a marked text: V vowel, C consonant, D digit, S other."""
    out = F.regexp_replace(mark, "[^a-z0-9V]", "S")
    out = F.regexp_replace(out, "[aeiou]", "V")
    return F.regexp_replace(F.regexp_replace(out, "[a-z]", "C"), "[0-9]", "D")


def _longest(text: Column, pattern: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))), F.lit(0))


def segments(local: Column) -> Column:
    """Parts between dots, underscores and hyphens; the whole where there are none."""
    parts = F.filter(F.split(local, "[._-]+"), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).when(F.length(local) > 0, F.array(local)).otherwise(F.array().cast("array<string>"))


def _tidy(local: Column) -> Column:
    return F.trim(F.lower(F.coalesce(local, F.lit(""))))


def _counts(x: Column, mark: Column, c: Column, seg: Column) -> dict[str, Column]:
    """What is counted in a text, its marked form, its classes and its segments."""
    count = lambda letter: F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))
    clusters = F.filter(F.regexp_extract_all(mark, F.lit("[b-df-hj-np-tv-z]{3,}"), F.lit(0)), lambda r: ~r.rlike("|".join(CLUSTERS)))
    tokens = F.regexp_extract_all(c, F.lit("[VC]+"), F.lit(0))
    lengths, n_seg = F.transform(seg, lambda p: F.length(p)), F.size(seg)
    return {
        "length": F.length(x), "vowels": count("V"), "consonants": count("C"), "digits": count("D"), "symbols": count("S"), "unique_chars": F.size(F.array_distinct(chars(x))),
        "max_vowel_run": _longest(c, "V+"), "max_consonant_run": _longest(c, "C+"), "max_digit_run": _longest(c, "D+"),
        "max_repeat_run": F.greatest(_longest(x, r"(.)\1+"), F.when(F.length(x) > 0, 1).otherwise(0)), "repeats": F.length(x) - F.length(F.regexp_replace(x, r"(.)\1+", "$1")),
        "impossible_clusters": F.size(clusters), "syllables": F.aggregate(tokens, F.lit(0), lambda a, t: a + F.greatest(F.lit(1), F.regexp_count(t, F.lit("V+")))),
        "has_word_boundaries": x.rlike("[._-]"), "segment_count": n_seg, "avg_segment_length": F.coalesce(F.length(x) / F.nullif(n_seg, F.lit(0)), F.lit(0.0)),
        "longest_segment": F.coalesce(F.array_max(lengths), F.lit(0)), "shortest_segment": F.coalesce(F.array_min(lengths), F.lit(0)),
        "segments_without_vowels_ratio": F.coalesce(F.size(F.filter(seg, lambda p: ~p.rlike("[aeiouy]"))) / F.nullif(n_seg, F.lit(0)), F.lit(0.0)),
        "bigram_entropy": bigram_entropy(x), "entropy": entropy(x)}


def _ratios(k: Callable[[str], Column], names: list[str]) -> Column:
    """The counts, and what follows from them."""
    letters1, length1 = F.greatest(k("vowels") + k("consonants"), F.lit(1)), F.greatest(k("length"), F.lit(1))
    sound = pronounceability(k("vowels") / letters1, k("max_consonant_run"), k("max_repeat_run"), k("digits") / length1, k("symbols") / length1, k("impossible_clusters"), k("segments_without_vowels_ratio"), k("has_word_boundaries"))
    return F.struct(
        *[k(n).alias(n) for n in names], (k("vowels") / letters1).alias("vowel_ratio"), (k("consonants") / letters1).alias("consonant_ratio"), (k("digits") / length1).alias("digit_ratio"),
        (k("symbols") / length1).alias("symbol_ratio"), (k("repeats") / length1).alias("repeated_char_ratio"), (k("unique_chars") / length1).alias("unique_char_ratio"), (k("max_consonant_run") / letters1).alias("vowel_gap_ratio"),
        F.when(k("length") == 0, 0.0).otherwise(sound).alias("pronounceability"))


COUNTS = [
    "length", "vowels", "consonants", "digits", "symbols", "unique_chars", "max_vowel_run", "max_consonant_run", "max_digit_run", "max_repeat_run", "repeats", "impossible_clusters", "syllables",
    "has_word_boundaries", "segment_count", "avg_segment_length", "longest_segment", "shortest_segment", "segments_without_vowels_ratio", "bigram_entropy", "entropy"]


def local_features(local: Column) -> Column:
    """S2-S9 of a local part as one struct; null and empty ones give zeros. Built in steps, so that no part is computed twice."""
    parts = lambda x: F.struct(x.alias("x"), marked(x).alias("m"), classes(marked(x)).alias("c"), segments(x).alias("seg"))
    counted = lambda s: F.struct(*[v.alias(n) for n, v in _counts(s["x"], s["m"], s["c"], s["seg"]).items()])
    return let(_tidy(local), lambda x: let(parts(x), lambda s: let(counted(s), lambda k: _ratios(lambda n: k[n], COUNTS))))


def with_local_features(df: DataFrame, local: Column, out: str) -> DataFrame:
    """df with local_features as a column, in steps."""
    return in_steps(
        df, out, lambda at: {"x": _tidy(local)}, lambda at: {"m": marked(at("x")), "seg": segments(at("x"))}, lambda at: {"c": classes(at("m"))},
        lambda at: _counts(at("x"), at("m"), at("c"), at("seg")), lambda at: {out: _ratios(at, COUNTS)})


def pronounceability(vowel_ratio, consonant_run, repeat_run, digit_ratio, symbol_ratio, impossible, vowelless, boundary) -> Column:
    """From 0 to 1."""
    zero = F.lit(0.0)
    penalty = (
        F.greatest(zero, (consonant_run - 2) / 10) + F.greatest(zero, (repeat_run - 2) / 12) + digit_ratio * 0.6 + symbol_ratio * 0.5
        + F.least(F.lit(1.0), impossible * F.lit(0.2)) + vowelless * 0.5)
    return clamp(vowel_ratio * 0.55 + (1 - penalty) * 0.45 + F.when(boundary, 0.05).otherwise(0.0), 0, 1)


def name_digit_hints(local: Column) -> Column:
    """has_year_suffix, alpha_prefix, alpha_prefix_naturalness, digit_position_ratio."""

    def rest(x: Column) -> Column:
        year = F.regexp_extract(x, r"([0-9]{4})$", 1)
        prefix = F.regexp_replace(F.regexp_replace(x, r"[0-9._-]+$", ""), "[^a-zA-Z]", "")
        at = F.regexp_instr(x, F.lit("[0-9]"))
        return let(prefix, lambda p: F.struct(
            F.when(year != "", year.cast("int").between(1940, LAST_BIRTH_YEAR)).otherwise(False).alias("has_year_suffix"), p.alias("alpha_prefix"),
            F.when(F.length(p) >= 2, naturalness(p)["overall_score"]).otherwise(0.0).alias("alpha_prefix_naturalness"),
            F.when(at > 0, (at - 1) / F.length(x)).otherwise(0.5).alias("digit_position_ratio")))

    return let(F.coalesce(local, F.lit("")), rest)
