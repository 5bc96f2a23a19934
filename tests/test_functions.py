"""Column functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from mailwarden.functions import address as a
from mailwarden.functions import domains as d
from mailwarden.functions import identity as i
from mailwarden.functions import lexical as x
from mailwarden.functions import ngrams as n
from mailwarden.functions import patterns as p


@pytest.fixture(scope="module")
def ask(spark):
    def run(build, *values):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
        return [r.out.asDict(recursive=True) if hasattr(r.out, "asDict") else r.out for r in df.select("k", build(F.col("v")).alias("out")).orderBy("k").collect()]

    return run


def test_cleaning(ask):
    got = ask(a.clean_address, " <Bob@X.com> ", "mailto:a@b.co", '"a b"@c..d', "a@@b.c", "a@b", "", None, "x@y.z.,;")
    assert got == ["bob@x.com", "a@b.co", "ab@c.d", None, None, None, None, "x@y.z"]


def test_format_and_validity(ask):
    assert ask(a.validate_format, "a.b@c.co", "é@ü.de", "a@b", "a@b.c", "a b@c.de", "x" * 65 + "@c.de", None, "a@-b.de") == [True, True, False, False, False, False, False, False]
    got = ask(a.validate_email, "ab@c.de", "john.smith@c.de", "nope", None)
    assert [(g["valid"], g["reason"]) for g in got] == [(False, "Email local part too short"), (True, None), (False, "Invalid email format"), (False, "Invalid email format")]


def test_normalize(ask):
    got = ask(a.normalize_email, "J.Doe+News@Gmail.com", "a.b+1@x.org", "no-at", None)
    assert [g["provider_normalized"] for g in got] == ["jdoe@gmail.com", "a.b@x.org", "no-at", None]
    assert [(g["plus_tag"], g["suspicious_tag"], g["dots_removed"]) for g in got[:2]] == [("news", False, 1), ("1", True, 0)]
    assert ask(a.mask_email, "johnny@x.com", "ab@x.com") == ["joh***@x.com", "ab@x.com"]


def test_sequential(ask):
    got = ask(lambda c: p.sequential(c, 2025), "user123@gmail.com", "andrew123@gmail.com", "john1990@x.com", "user001@x.com", "a.001.b@x.com", "x@y.z", None)
    assert [(g["is_sequential"], g["base"]) for g in got] == [(True, "user"), (False, "andrew123"), (False, "john1990"), (True, "user"), (True, "a.[NUM].b"), (False, "x"), (False, "")]
    assert got[0]["sequence"] == 123
    assert ask(lambda c: p.sequential_family(c, 2025), "user001@x.com", "bob@x.com") == ["user[NUM]@x.com", None]


def test_dated(ask):
    got = ask(lambda c: p.dated(c, 2025), "john20240115@x.com", "bob_oct2025@x.com", "ann1990@x.com", "2024.bob@x.com", "smith99@x.com", "abc12@x.com", "john20241315@x.com", None)
    assert [g["type"] for g in got] == ["full-date", "month-year", "year", "year", "short-year", "none", "short-year", "none"]
    assert [round(g["confidence"], 2) for g in got[:5]] == [0.9, 1.0, 0.25, 1.0, 0.15]


def test_families(ask):
    got = ask(lambda c: p.pattern_family(c, 2025), "user5001@gmail.com", "bob+test@gmail.com", "xkqzvbnmwp@x.com", "jane.doe@x.com", "janedoe@x.com")
    assert [g["type"] for g in got] == ["sequential", "plus-addressing", "random", "formatted", "simple"]
    assert got[3]["family"] == "NAME.NAME@x.com" and len(got[0]["family_hash"]) == 16
    assert ask(p.plus_risk, "user+news@gmail.com", "user+1@gmail.com", "u@gmail.com") == [0.2, 0.5, 0.0]


def test_local_features(ask):
    got = ask(x.local_features, "qbekzs", "sssssss934", "happy.wally", "", None)
    assert got[0]["impossible_clusters"] == 1 and got[1]["max_repeat_run"] == 7 and got[2]["has_word_boundaries"]
    assert got[3]["length"] == got[4]["length"] == 0 and got[3]["pronounceability"] == 0
    assert ask(x.entropy, "", "aaaa", "ab") == [0.0, 0.0, pytest.approx(1 / 6.6)]


def plain_features(local):
    """The same counts, character by character."""
    kinds = []
    for k, c in enumerate(local):
        before, after = local[k - 1] if k else "", local[k + 1] if k + 1 < len(local) else ""
        if c.isdigit():
            kinds.append("D")
        elif not ("a" <= c <= "z"):
            kinds.append("S")
        elif c in "aeiou":
            kinds.append("V")
        elif c == "y":
            kinds.append("C" if before and before in "aeiou" or after and after in "aeiou" else "V")
        elif c == "w":
            kinds.append("V" if before and before in "aeiou" else "C")
        else:
            kinds.append("C")
    runs = "".join(kinds)
    longest = lambda k: max(map(len, "".join(y if y == k else " " for y in runs).split()), default=0)
    return runs.count("V"), runs.count("C"), runs.count("D"), runs.count("S"), longest("V"), longest("C"), longest("D")


def test_classes_against_plain_python(ask):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("aeiouywbst19._-é") for _ in range(rng.randint(1, 15))) for _ in range(300)]
    got = ask(x.local_features, *texts)
    keys = ("vowels", "consonants", "digits", "symbols", "max_vowel_run", "max_consonant_run", "max_digit_run")
    assert [tuple(g[k] for k in keys) for g in got] == [plain_features(t) for t in texts]


def test_languages_and_naturalness(ask):
    assert ask(n.detect_language, "petrov", "gonzalez", "rousseau", "hoffmann", "bertolini", "coutinho", "smith", "ivanenko", None) == ["romanized", "es", "fr", "de", "it", "pt", "en", "romanized", "en"]
    got = ask(n.naturalness, "anderson", "xkqzvbn", "é", "ÀÉbc")
    assert got[0]["is_natural"] and not got[1]["is_natural"] and got[2]["total_bigrams"] == 0 and got[3]["total_bigrams"] == 3
    assert ask(n.ngram_risk, "ab", "xkqzvbnm")[0] == 0.1


def test_domains(spark):
    df = spark.createDataFrame([(v,) for v in ("gmail.com", "mailinator.com", "my-temp-mail.org", "a.vercel.app", "x.tk", "b", "12345.com", None, "mail.com")], "domain string")
    rows = d.with_tld(d.with_disposable(df)).select("domain", d.validate_domain(F.col("domain"), F.col("listed")).alias("v"), d.domain_reputation(F.col("domain"), F.col("listed")).alias("r"), "tld").collect()
    by = {r.domain: r for r in rows}
    assert by["mailinator.com"].v.reason == "Known disposable email domain" and by["my-temp-mail.org"].v.reason == "Domain matches disposable pattern"
    assert by["gmail.com"].r == 0.1 and by["mail.com"].r == 0.6 and by["mailinator.com"].r == 1.0
    assert by["a.vercel.app"].tld.platform == "vercel" and by["a.vercel.app"].tld.registrable_domain == "a.vercel.app"
    assert by["x.tk"].tld.is_high_risk and by["b"].v.reason == "Invalid domain structure" and by[None].v.reason == "Empty domain"
    updated = d.override_profiles(d.tld_table(spark), spark.createDataFrame([("tk", 0.2)], "tld string, risk_multiplier double"))
    assert updated.where("tld = 'tk'").first().risk_multiplier == 0.2
    with pytest.raises(ValueError):
        d.override_profiles(d.tld_table(spark), spark.createDataFrame([("nope", 1.0)], "tld string, risk_multiplier double"))


def test_mx(spark):
    records = spark.createDataFrame([("a.com", 0, "10 mail.a.com.", 60), ("a.com", 1, "20 alt.l.google.com.", 60), ("a.com", 2, "30 alt2.l.google.com", 90), ("b.com", 0, "bad", 5)], "domain string, position long, data string, ttl long")
    got = {r.domain: r for r in d.mx_analysis(records).collect()}
    assert (got["a.com"].mx_record_count, got["a.com"].mx_google, got["a.com"].mx_self_hosted, got["a.com"].mx_primary_provider, got["a.com"].mx_ttl) == (3, 2, 1, "google", 90)
    assert (got["b.com"].mx_record_count, got["b.com"].mx_primary_provider, got["b.com"].mx_has_records) == (0, None, False)


def test_identity_and_geo(spark):
    df = spark.createDataFrame([("John Smith", "jsmith"), (None, "x"), ("Ann", ""), ("李", "li")], "name string, local string")
    got = [r.v for r in df.select(i.identity(F.col("name"), F.col("local")).alias("v")).collect()]
    assert got[0].similarity == pytest.approx(6 / 9) and got[0].token_overlap == 0.5 and got[0].name_in_email
    assert [g.similarity for g in got[1:]] == [0, 0, 0]
    g = spark.range(1).select(i.geo(F.lit("us"), F.lit("de-DE,en"), F.lit("A"), F.lit("B")).alias("v")).first().v
    assert (g.language_mismatch, g.timezone_mismatch, g.anomaly_score) == (True, True, 1.0)
    assert i.lcs_length("abcbdab", "bdcaba") == 4


def test_subsequences_of_columns():
    import random

    import pandas as pd

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcz") for _ in range(n))
    pairs = [(word(r.randint(0, 12)), word(r.randint(0, 70))) for _ in range(400)] + [(word(n), word(m)) for n in (63, 64, 65, 90) for m in (10, 63, 64, 65, 200)] + [("", ""), (None, "a"), ("a", None)]
    got = i.lcs_lengths(pd.Series([a for a, _ in pairs], dtype=object), pd.Series([b for _, b in pairs], dtype=object))
    assert got.tolist() == [plain(a or "", b or "") for a, b in pairs]
    assert all(i.lcs_length(a or "", b or "") == plain(a or "", b or "") for a, b in pairs)
    assert i.lcs_lengths(pd.Series([], dtype=object), pd.Series([], dtype=object)).tolist() == []
