"""Naturalness of names by common letter pairs and triples of eight language groups."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_steps, let
from .grams import BIGRAMS, ENGLISH_BIGRAMS, ENGLISH_TRIGRAMS, TRIGRAMS

# Endings and patterns of languages, the first that matches counts.
LANGUAGE_PATTERNS = (
    ("romanized", r"(ov|ova|ovich|ev|eva|enko|sky|ski|ashvili|adze|dze)$|(ullah|rahman|hossain|hussein)$|^(abd|abu|ibn|bin)|(putra|putri|wati|wana|wan|budi|sri|dra|tya)$|(kumar|singh|raj|deep|esh|ish)$|(nguyen|quang|thuy|phuong|trung|trong)$|(kim|park|choi|yoon|kang|lee)$|(zhang|xiang|sheng|huang|xiao|qian)$"),
    ("es", r"ñ|(ez|iz|oz|az)$"),
    ("fr", r"(eau|eaux|eux|ette|elle|ille|ois|oit)$"),
    ("de", r"(mann|berg|stein|stadt|hardt)$|(ae|oe|ue)|(sch|tz|pf)"),
    ("it", r"(ini|lli|tti|cci|gia|gio|zio|zzi|azzi|etti)$"),
    ("pt", r"(ão|õe|ãe)$|(inho|inha|lh|nh)$|(cao|sao)$"),
)
LANGUAGE_NAMES = {"en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "romanized": "Romanized", "universal": "Universal"}


def _accents() -> tuple[str, str]:
    """Precomposed letters whose base is an ASCII letter, and those letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(0x300 <= ord(c) <= 0x36F for c in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents: precomposed ones by table, and combining marks dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def detect_language(text: Column) -> Column:
    """The first language whose pattern matches; en without one."""
    lower = F.lower(text)
    out = F.when(lower.rlike(LANGUAGE_PATTERNS[0][1]), LANGUAGE_PATTERNS[0][0])
    for name, pattern in LANGUAGE_PATTERNS[1:]:
        out = out.when(lower.rlike(pattern), name)
    return out.otherwise("en")


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def one_of(words) -> str:
    """A pattern for words of one length, as a tree of letters: a place that fits none fails at its first letters."""
    rest: dict[str, set[str]] = {}
    for w in words:
        rest.setdefault(w[0], set()).add(w[1:])
    if all(own == {""} for own in rest.values()):
        return f"[{''.join(sorted(rest))}]"
    return "|".join(f"{first}{one_of(own) if all(len(w) == 1 for w in own) else f'(?:{one_of(own)})'}" for first, own in sorted(rest.items()))


def _hits(clean: Column, found) -> Column:
    """How many windows of a text are in a set of words of one length: places where one of the set begins."""
    return F.regexp_count(clean, F.lit(f"(?={one_of(set(found))})"))


def _by_language(clean: Column, language: Column, sets: dict[str, list[str]]) -> Column:
    out = None
    for name, own in sets.items():
        if name != "universal":
            hit = _hits(clean, [*own, *sets["universal"]])
            out = F.when(language == name, hit) if out is None else out.when(language == name, hit)
    return out.otherwise(_hits(clean, sets["universal"]))


def _share(hits: Column, clean: Column, n: int) -> Column:
    total = F.length(clean) - (n - 1)
    return F.when(total > 0, hits / total).otherwise(0.0)


def multilingual_score(text: Column, language: Column | None = None) -> Column:
    """Language, bigram_score, trigram_score, overall_score, is_natural."""
    lang = detect_language(text) if language is None else language

    def rest(s: Column) -> Column:
        clean, lang = s["clean"], s["lang"]
        two, three = _share(_by_language(clean, lang, BIGRAMS), clean, 2), _share(_by_language(clean, lang, TRIGRAMS), clean, 3)
        return let(F.struct(lang.alias("language"), two.alias("bigram_score"), three.alias("trigram_score")), lambda r: let(r["bigram_score"] * 0.6 + r["trigram_score"] * 0.4, lambda overall: F.struct(
            r["language"].alias("language"), r["bigram_score"].alias("bigram_score"), r["trigram_score"].alias("trigram_score"), overall.alias("overall_score"),
            (overall > F.when(r["language"] == "en", 0.40).otherwise(0.30)).alias("is_natural"))))

    return let(F.struct(letters(text).alias("clean"), lang.alias("lang")), rest)


def naturalness(text: Column, multilingual: bool = True) -> Column:
    """N1's fields, confidence, and counts of windows and of matched ones.

    Windows are counted after accents are stripped; in multilingual mode scores are over letters a-z as they stand.
    """
    base = letters(strip_accents(text))
    if multilingual:
        score = multilingual_score(text)
    else:
        score = let(base, lambda b: let(_share(_hits(b, ENGLISH_BIGRAMS), b, 2), lambda two: let(_share(_hits(b, ENGLISH_TRIGRAMS), b, 3), lambda three: F.struct(
            F.lit("en").alias("language"), two.alias("bigram_score"), three.alias("trigram_score"), (two * 0.6 + three * 0.4).alias("overall_score"),
            ((two * 0.6 + three * 0.4) > F.when(F.length(text) < 5, 0.30).otherwise(0.40)).alias("is_natural")))))

    def rest(s: Column) -> Column:
        r = s["r"]
        return _counted(r["language"], r["bigram_score"], r["trigram_score"], r["overall_score"], r["is_natural"], s["n"])

    return let(F.struct(score.alias("r"), F.length(base).alias("n")), rest)


def with_naturalness(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with a column of N2's fields for a text, as naturalness has them, in steps."""
    return in_steps(
        df, out, lambda at: {"text": text},
        lambda at: {"clean": letters(at("text")), "lang": detect_language(at("text")), "n": F.length(letters(strip_accents(at("text"))))},
        lambda at: {"two": _share(_by_language(at("clean"), at("lang"), BIGRAMS), at("clean"), 2), "three": _share(_by_language(at("clean"), at("lang"), TRIGRAMS), at("clean"), 3)},
        lambda at: {"overall": at("two") * 0.6 + at("three") * 0.4},
        lambda at: {out: _counted(at("lang"), at("two"), at("three"), at("overall"), at("overall") > F.when(at("lang") == "en", 0.40).otherwise(0.30), at("n"))})


def _counted(language: Column, bigram: Column, trigram: Column, overall: Column, natural: Column, n: Column) -> Column:
    """N2's fields; n is the text's length in letters."""
    two, three = F.greatest(n - 1, F.lit(0)), F.greatest(n - 2, F.lit(0))
    return F.struct(
        language.alias("language"), bigram.alias("bigram_score"), trigram.alias("trigram_score"), overall.alias("overall_score"), natural.alias("is_natural"),
        F.least((two + three) / 10, F.lit(1.0)).alias("confidence"), two.alias("total_bigrams"), three.alias("total_trigrams"),
        F.floor(two * bigram + 0.5).cast("int").alias("matched_bigrams"), F.floor(three * trigram + 0.5).cast("int").alias("matched_trigrams"))


def ngram_risk(text: Column, natural: Column | None = None) -> Column:
    """From 0 to 1; 0.1 under three characters."""
    n = naturalness(text) if natural is None else natural
    base = lambda r: F.greatest(F.lit(0.0), 1 - r["overall_score"] / F.when(F.length(text) < 5, 0.30).otherwise(0.40)) * r["confidence"]
    return F.when(F.length(text) < 3, 0.1).otherwise(F.least(let(n, base), F.lit(1.0)))


def compare_modes(text: Column) -> Column:
    """The scores of both modes, and whether only the multilingual one finds the text natural."""
    return let(F.struct(naturalness(text, False).alias("e"), naturalness(text).alias("m")), lambda s: F.struct(
        s["e"]["overall_score"].alias("english_score"), s["m"]["overall_score"].alias("multilingual_score"), s["m"]["language"].alias("language"),
        (s["m"]["is_natural"] & ~s["e"]["is_natural"]).alias("improved")))
