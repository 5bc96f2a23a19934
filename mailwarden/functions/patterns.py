"""Pattern detectors over addresses: numbered, dated, aliased and random local parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .address import domain_part, local_part, normalize_email, tidy
from .common import in_steps, let
from .ngrams import naturalness, with_naturalness

# Fixed values.
COMMON_BASES = ("test", "user", "account", "email", "temp", "demo", "admin", "guest", "trial", "sample", "hello", "service", "team", "info", "support", "member")
MONTHS = ("jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december")
TEST_WORDS = ("test", "temp", "fake", "spam", "admin", "root", "demo", "trial", "sample", "example", "null", "void")
FREE_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "aol.com", "protonmail.com", "mail.com")
DISPOSABLE_WORDS = ("temp", "trash", "disposable", "throwaway", "fake", "guerrilla", "mailinator", "minute")
YEAR = "(20[0-9]{2}|19[0-9]{2})"
FULL_DATE = rf"^(.+?)[._-]?{YEAR}[._-]?([0-9]{{2}})[._-]?([0-9]{{2}})([._-].+)?$"
MONTH_YEAR = rf"^(.+?)[._-]?({'|'.join(MONTHS)}|[0-9]{{2}}){YEAR}([._-].+)?$"
ANY_YEAR = rf"^(.+?)[._-]?{YEAR}([._-].+)?$"
LEADING_YEAR = rf"^{YEAR}[._-](.+)$"
SHORT_YEAR = r"^(.+?)[._-]?([0-9]{2})$"


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def _sequence(found: Column, base: Column, number: Column, confidence: Column, length: Column) -> Column:
    return F.struct(
        (found & (confidence >= 0.4)).alias("is_sequential"), base.alias("base"), F.when(found, number.cast("decimal(38,0)").cast("double")).alias("sequence"), confidence.alias("confidence"),
        F.coalesce((F.length(number) > 1) & number.startswith("0"), F.lit(False)).alias("leading_zeros"), length.alias("seq_len"))


def sequential(email: Column, as_of_year: int) -> Column:
    """is_sequential, base, sequence, confidence, leading_zeros, seq_len of an address.

    sequence is a double; over 38 digits it is null. Local parts under two characters, and null, aren't sequential.
    """
    none = F.lit(None).cast("string")
    birth = lambda digits: F.when(F.length(digits) >= 4, F.exists(
        F.transform(F.sequence(F.lit(1), F.length(digits) - 3), lambda i: F.substring(digits, i, F.lit(4)).cast("int")),
        lambda y: y.between(max(1940, as_of_year - 100), as_of_year - 13))).otherwise(False)

    def rest(s: Column) -> Column:
        x, base, number = s["x"], s["base"], s["number"]
        n, size = F.length(number), F.length(base)
        zeros = (n > 1) & number.startswith("0")
        common = base.rlike("|".join(COMMON_BASES))
        ratio = n / F.length(x)
        score = (F.when(n == 1, 0.25).when(n == 2, 0.35).when(n == 3, 0.5).otherwise(0.7) + F.when(zeros, 0.3).otherwise(0.0) + F.when(ratio > 0.5, 0.2).when(ratio > 0.3, 0.1).otherwise(0.0)
                 + F.when((size == 1) & (n >= 2), 0.2).otherwise(0.0) + F.when(common, 0.25).otherwise(0.0) + F.when(common & (n <= 2), 0.1).otherwise(0.0))
        not_one = _sequence(F.lit(False), x, none, F.lit(0.0), F.lit(0))
        middle = _group(x, r"^(.+?)[._-]([0-9]+)[._-](.+)$", 2)
        middle_score = F.lit(0.3) + F.when(F.length(middle) >= 3, 0.2).otherwise(0.0) + F.when((F.length(middle) > 1) & middle.startswith("0"), 0.2).otherwise(0.0)
        middle_base = F.concat(_group(x, r"^(.+?)[._-]([0-9]+)[._-](.+)$", 1), F.lit(".[NUM]."), _group(x, r"^(.+?)[._-]([0-9]+)[._-](.+)$", 3))
        plain = (n <= 3) & (size >= 4) & ~zeros & ~common
        return (F.when(F.coalesce(F.length(x), F.lit(0)) < 2, _sequence(F.lit(False), F.coalesce(x, F.lit("")), none, F.lit(0.0), F.lit(0)))
                .when((n > 0) & (birth(number) | plain), not_one)
                .when(n > 0, _sequence(F.lit(True), base, number, F.least(score, F.lit(1.0)), n))
                .when(middle != "", _sequence(F.lit(True), middle_base, middle, middle_score, F.length(middle))).otherwise(not_one))

    start = local_part(tidy(email))
    return let(F.struct(start.alias("x"), _group(start, r"^(.+?)([0-9]+)$", 1).alias("base"), _group(start, r"^(.+?)([0-9]+)$", 2).alias("number")), rest)


def sequential_family(email: Column, as_of_year: int) -> Column:
    """base[NUM]@domain of a sequential address; else null."""
    s = sequential(email, as_of_year)
    return let(s, lambda r: F.when(r["is_sequential"], F.concat(r["base"], F.lit("[NUM]@"), domain_part(F.lower(email)))))


def year_age(year: Column, kind: str, as_of_year: int) -> Column:
    """Risk, category, suspicious of a year in an address; kind is year, month-year, full-date or short-year."""
    age = F.lit(as_of_year) - year
    birth_risk = {"month-year": 0.60, "full-date": 0.75}.get(kind, 0.20)
    risk = F.when(age < 0, 0.95).when(age <= 2, 0.90).when(age <= 12, 0.70).when(age <= 65, birth_risk).when(age <= 100, 0.40).otherwise(0.80)
    category = F.when(age < 0, "future").when(age <= 2, "recent_timestamp").when(age <= 12, "underage").when(age <= 65, "plausible_birth_year").when(age <= 100, "elderly_birth_year").otherwise("ancient")
    return F.struct(risk.alias("risk"), category.alias("category"), (F.when(age.between(13, 65), kind in ("month-year", "full-date")).otherwise(~age.between(66, 100))).alias("suspicious"))


def dated(email: Column, as_of_year: int) -> Column:
    """Has, base, date_component, type, confidence, year, month, position, age, category, suspicious.

    The first pattern that matches and holds counts: full date, month and year, year, leading year, two-digit year.
    Local parts under four characters, and null, have none.
    """
    null = F.lit(None).cast("string")

    def hit(base, component, kind, year, month, position, bump) -> Column:
        return let(F.struct(year.alias("y"), year_age(year, kind, as_of_year).alias("a")), lambda s: F.struct(
            F.lit(True).alias("has"), base.alias("base"), component.alias("date_component"), F.lit(kind).alias("type"), F.greatest(F.lit(0.0), F.least(bump(s["a"]["risk"], s["y"]), F.lit(1.0))).alias("confidence"),
            s["y"].alias("year"), month.alias("month"), position.alias("position"), (F.lit(as_of_year) - s["y"]).alias("age"), s["a"]["category"].alias("category"), s["a"]["suspicious"].alias("suspicious")))

    def framed(x, pattern, suffix_group, token) -> tuple[Column, Column]:
        prefix, suffix = _group(x, pattern, 1), _group(x, pattern, suffix_group)
        base = F.when(suffix != "", F.concat(prefix, F.lit(f".[{token}]."), F.substring(suffix, F.lit(2), F.length(suffix)))).otherwise(prefix)
        return base, F.when(suffix != "", "middle").otherwise("trailing")

    def rest(x: Column) -> Column:
        year = lambda p, n: _group(x, p, n).cast("int")
        none = F.struct(
            F.lit(False).alias("has"), F.coalesce(x, F.lit("")).alias("base"), null.alias("date_component"), F.lit("none").alias("type"), F.lit(0.0).alias("confidence"), F.lit(None).cast("int").alias("year"),
            null.alias("month"), null.alias("position"), F.lit(None).cast("int").alias("age"), null.alias("category"), F.lit(None).cast("boolean").alias("suspicious"))
        month, day = _group(x, FULL_DATE, 3), _group(x, FULL_DATE, 4)
        full_base, full_at = framed(x, FULL_DATE, 5, "DATE")
        full = hit(full_base, F.concat(_group(x, FULL_DATE, 2), month, day), "full-date", year(FULL_DATE, 2), month, full_at, lambda r, y: r)
        my_base, my_at = framed(x, MONTH_YEAR, 4, "MONTH-YEAR")
        my = hit(my_base, F.concat(_group(x, MONTH_YEAR, 2), _group(x, MONTH_YEAR, 3)), "month-year", year(MONTH_YEAR, 3), _group(x, MONTH_YEAR, 2), my_at,
                 lambda r, y: F.when(y.isin(as_of_year, as_of_year + 1), r + 0.1).otherwise(r))
        y_base, y_at = framed(x, ANY_YEAR, 3, "YEAR")
        y_only = hit(y_base, _group(x, ANY_YEAR, 2), "year", year(ANY_YEAR, 2), null, y_at, lambda r, y: F.when(y_at == "trailing", r + 0.05).otherwise(r - 0.05))
        leading = hit(_group(x, LEADING_YEAR, 2), _group(x, LEADING_YEAR, 1), "year", year(LEADING_YEAR, 1), null, F.lit("leading"), lambda r, y: r + 0.1)
        two = year(SHORT_YEAR, 2)
        short_year = F.when(two <= 40, two + 2000).otherwise(two + 1900)
        short = let(hit(_group(x, SHORT_YEAR, 1), _group(x, SHORT_YEAR, 2), "short-year", short_year, null, F.lit("trailing"), lambda r, y: r - 0.05), lambda h: F.when(h["confidence"] < 0.10, none).otherwise(h))
        return (F.when(F.coalesce(F.length(x), F.lit(0)) < 4, none)
                .when(x.rlike(FULL_DATE) & month.cast("int").between(1, 12) & day.cast("int").between(1, 31), full)
                .when(x.rlike(MONTH_YEAR), my).when(x.rlike(ANY_YEAR), y_only).when(x.rlike(LEADING_YEAR), leading)
                .when(x.rlike(SHORT_YEAR) & (F.length(_group(x, SHORT_YEAR, 1)) >= 4), short).otherwise(none))

    return let(local_part(tidy(email)), rest)


def dated_family(email: Column, as_of_year: int) -> Column:
    """P5: [PATTERN].[YEAR]@domain and the like for a dated address; else null."""
    token = lambda r: F.when(r["type"].isin("year", "short-year"), "[YEAR]").when(r["type"] == "month-year", "[MONTH-YEAR]").otherwise("[DATE]")
    return let(dated(email, as_of_year), lambda r: F.when(r["has"], F.concat(F.lit("[PATTERN]."), token(r), F.lit("@"), domain_part(F.lower(email)))))


def is_current_date(component: Column, as_of) -> Column:
    """Whether a date component has the year, or the short month name, of as_of (a date)."""
    return component.contains(str(as_of.year)) | component.contains(as_of.strftime("%b").lower())


def _name_like(text: Column) -> Column:
    return text.rlike("^[a-z]{2,15}$") & ~F.lower(text).isin(*TEST_WORDS)


def structure(local: Column) -> Column:
    """The kinds of the parts between dots, underscores and hyphens, joined by dots."""
    one = F.when(F.length(local) <= 4, "SHORT").when(_name_like(local), "NAME").otherwise("WORD")
    part = lambda p: F.when(p.rlike("^[0-9]+$"), "NUM").when(_name_like(p), "NAME").when(F.length(p) <= 3, "SHORT").otherwise("WORD")
    return F.when(~local.rlike("[._-]"), one).otherwise(F.array_join(F.transform(F.split(local, "[._-]", -1), part), "."))


def is_random(local: Column) -> Column:
    """Whether a local part looks random."""
    return F.coalesce(let(naturalness(local), lambda n: _random(local, n)), F.lit(False))


def _random(local: Column, n: Column) -> Column:
    """P8 from the local part's naturalness."""
    size = F.length(local)
    vowels = F.regexp_count(F.lower(local), F.lit("[aeiou]")) / size
    odd = (vowels < 0.15) | (vowels > 0.7)
    dense = (F.size(F.array_distinct(F.filter(F.split(local, ""), lambda c: c != ""))) / size > 0.75) & (size >= 8)
    mixed = local.rlike("[a-zA-Z]") & local.rlike("[0-9]") & ~local.rlike("[._-]")
    found = (n["confidence"] > 0.7) & (dense | odd) | (n["confidence"] > 0.6) & (mixed | dense & odd)
    return F.when(n["is_natural"] & (n["confidence"] > 0.5), False).when(size < 8, False).otherwise(~n["is_natural"] & found)


def domain_type(domain: Column) -> Column:
    """P10: free, disposable, business or unknown."""
    return (F.when(domain.isin(*FREE_DOMAINS), "free").when(domain.rlike("|".join(DISPOSABLE_WORDS)), "disposable")
            .when(~domain.contains("mail") & (F.regexp_count(domain, F.lit(r"\.")) == 1), "business").otherwise("unknown"))


def pattern_family(email: Column, as_of_year: int) -> Column:
    """Family, family_hash, type, confidence and more of an address.

    The detectors run on the address as its provider reads it; structure and domain come from the one without its tag.
    """
    def choose(s: Column) -> Column:
        local = local_part(s["n"]["normalized"])
        return _family(s["n"], s["d"], s["q"], local, domain_part(s["n"]["normalized"]), structure(local), is_random(local))

    def detect(n: Column) -> Column:
        return let(F.struct(n.alias("n"), dated(n["provider_normalized"], as_of_year).alias("d"), sequential(n["provider_normalized"], as_of_year).alias("q")), choose)

    return let(normalize_email(email), detect)


def _family(n: Column, d: Column, q: Column, local: Column, domain: Column, shape: Column, random: Column) -> Column:
    """P9's fields from the address's normal form, its date, its number, and what the local part without tag looks like."""
    token = lambda t: F.when(t == "year", "YEAR").when(t == "short-year", "YY").when(t == "month-year", "MONTH-YEAR").otherwise("DATE")
    at = lambda *parts: F.concat(*parts, F.lit("@"), domain)
    is_dated, is_seq = d["has"] & (d["confidence"] >= 0.6), q["is_sequential"] & (q["confidence"] >= 0.5)
    pick = lambda family, kind, c: F.struct(family.alias("family"), F.lit(kind).alias("type"), c.cast("double").alias("confidence"))
    found = (F.when(is_dated, pick(at(structure(d["base"]), F.lit("."), token(d["type"])), "dated", d["confidence"]))
             .when(is_seq, pick(at(structure(q["base"]), F.lit(".NUM")), "sequential", q["confidence"]))
             .when(n["has_plus"], pick(at(shape, F.lit("+TAG")), "plus-addressing", F.when(n["suspicious_tag"], 0.7).otherwise(0.5)))
             .when(random, pick(at(F.lit("RANDOM")), "random", F.lit(0.6)))
             .when(local.rlike("[._-]"), pick(at(shape), "formatted", F.lit(0.4)))
             .otherwise(pick(at(shape), "simple", F.lit(0.3))))
    return let(found, lambda f: F.struct(
        f["family"].alias("family"), F.substring(F.sha2(f["family"], 256), 1, 16).alias("family_hash"), f["type"].alias("type"), f["confidence"].alias("confidence"), n["normalized"].alias("normalized"),
        q["is_sequential"].alias("has_sequential"), d["has"].alias("has_dated"), n["has_plus"].alias("has_plus"), shape.alias("structure"), domain_type(domain).alias("domain_type")))


def with_pattern_family(df: DataFrame, email: Column, as_of_year: int, out: str, normal: Column | None = None, number: Column | None = None) -> DataFrame:
    """df with a column of P9's fields, in steps. normal and number: normalize_email and sequential of the address, where df has them already."""
    natural = f"{out}.natural"
    df = in_steps(df, f"{out}.n", lambda at: {"n": normalize_email(email) if normal is None else normal})
    n = F.col(f"`{out}.n`")
    df = df.withColumns({f"{out}.local": local_part(n["normalized"]), f"{out}.domain": domain_part(n["normalized"]), f"{out}.d": dated(n["provider_normalized"], as_of_year), f"{out}.q": sequential(n["provider_normalized"], as_of_year) if number is None else number})
    local = F.col(f"`{out}.local`")
    df = with_naturalness(df, local, natural).withColumns({f"{out}.shape": structure(local), f"{out}.random": F.coalesce(_random(local, F.col(f"`{natural}`")), F.lit(False))})
    made = ("n", "d", "q", "local", "domain", "shape", "random")
    return df.withColumn(out, _family(*[F.col(f"`{out}.{k}`") for k in made])).drop(natural, *[f"{out}.{k}" for k in made])


def plus_risk(email: Column, group_size: Column | None = None) -> Column:
    """0.2 for a plus tag, 0.3 more for a suspicious one, 0.4 more where its alias group (see operators.batch) has three or more."""
    row = let(normalize_email(email), lambda n: F.when(n["has_plus"] & n["suspicious_tag"], 0.5).when(n["has_plus"], 0.2).otherwise(0.0))
    return row if group_size is None else F.least(row + F.when(group_size >= 3, 0.4).otherwise(0.0), F.lit(1.0))
