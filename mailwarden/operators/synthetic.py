"""Synthetic sign-ups and look-alike domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed import unit

# Kinds of fraud and their weights; substitutions of look-alike characters; endings that are mistaken.
FRAUD_WEIGHTS = (
    ("sequential", 10), ("gibberish", 6), ("alphanumeric", 6), ("hex", 5), ("uuid", 5), ("base64", 4), ("consonants", 4), ("dated", 6), ("disposable", 12), ("plus", 10), ("keyboard", 8), ("repeated", 8), ("mixed_case", 6),
    ("heavy_number", 10), ("typosquat", 30), ("vpn", 8), ("homoglyph", 30), ("ai_gibberish", 8))
SUBSTITUTIONS = {"a": ("@", "4"), "e": ("3",), "i": ("1", "l", "!"), "o": ("0",), "s": ("5", "$"), "l": ("1", "i"), "t": ("7",), "g": ("9", "q"), "m": ("n", "rn"), "n": ("m",)}
TLD_MISTAKES = ("com", "co", "net", "org", "io", "me")
NEAR_MISS, DATED_LEGIT, NO_NAME = 0.20, 0.15, 0.40
# Made-up material.
FIRST = ("Anna", "Carlos", "Dmitry", "Emma", "Giovanni", "Hans", "Julia", "Kenji", "Laura", "Maria", "Nina", "Omar", "Paul", "Priya", "Sofia", "Thomas")
LAST = ("Berg", "Costa", "Fischer", "Garcia", "Ivanov", "Jones", "Kim", "Lopez", "Meyer", "Novak", "Petrov", "Rossi", "Sato", "Silva", "Smith", "Weber")
DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "proton.me", "gmx.de", "orange.fr")
THROWAWAY = ("mailinator.com", "guerrillamail.com", "10minutemail.com", "yopmail.com", "tempmail.com")
TUNNELS = ("vpn-exit.net", "proxy-mail.org", "tunnel.example")
LOOKALIKES = ("gmai1.com", "gmial.com", "gmaill.com", "yah00.com", "yaho.com", "out1ook.com", "outlok.com", "hotmai1.com", "hotmial.com", "ic1oud.com", "icloud.co", "protom.me")
SYLLABLES = ("zor", "vex", "lum", "qir", "nax", "tel", "byn", "dra", "osk", "pli")
CONSONANTS, VOWELS, LETTERS, HEX = "bcdfghjklmnpqrstvwxyz", "aeiou", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Latin letters and their Cyrillic doubles.
DOUBLES = ("aeopcxy", "аеорсху")


def typosquat_variants(domain: Column) -> Column:
    """Look-alikes of a domain name: substitutions, swaps, doubled and missing letters (three or more left), other endings. The domain itself may be among them where a swap changes nothing."""
    name, tld = F.substring_index(domain, ".", 1), F.element_at(F.split(domain, r"\."), 2)
    size = F.length(name)
    places = F.sequence(F.lit(1), size)
    head = lambda i: F.substring(name, F.lit(1), i - 1)
    tail = lambda i, k=1: F.substring(name, i + k, size)
    at = lambda i: F.substring(name, i, F.lit(1))
    end = lambda x: F.concat(x, F.lit("."), tld)
    subs = F.create_map(*[F.lit(x) for k, v in SUBSTITUTIONS.items() for x in (k, "|".join(v))])
    replaced = F.flatten(F.transform(places, lambda i: F.transform(F.filter(F.split(F.coalesce(subs[at(i)], F.lit("")), r"\|"), lambda s: s != ""), lambda s: end(F.concat(head(i), s, tail(i))))))
    swaps = F.filter(F.transform(places, lambda i: F.when(i < size, end(F.concat(head(i), at(i + 1), at(i), tail(i, 2))))), lambda x: x.isNotNull())
    doubled = F.transform(places, lambda i: end(F.concat(head(i), at(i), at(i), tail(i))))
    missing = F.when(size >= 4, F.transform(places, lambda i: end(F.concat(head(i), tail(i))))).otherwise(F.array().cast("array<string>"))
    endings = F.transform(F.filter(F.array(*[F.lit(t) for t in TLD_MISTAKES]), lambda t: t != tld), lambda t: F.concat(name, F.lit("."), t))
    return F.concat(replaced, swaps, doubled, missing, endings)


def lookalikes(df: DataFrame, domain: str, providers: DataFrame) -> DataFrame:
    """df's rows whose domain is a look-alike of one of providers (domain): `imitates` names it. The variants are a table to join with."""
    table = providers.select(F.col("domain").alias("imitates"), F.explode(typosquat_variants(F.col("domain"))).alias("variant")).groupBy("variant").agg(F.min("imitates").alias("imitates"))
    real = providers.select(F.col("domain").alias("real"))
    return df.join(table, F.lower(F.col(domain)) == F.col("variant")).join(real, F.lower(F.col(domain)) == F.col("real"), "left_anti").drop("variant")


class Columns:
    """Draws and texts as Spark columns, from an id and a seed alone. plans.synthetic_oracles has the same in SQL."""

    def __init__(self, seed: int):
        self.seed = seed

    def unit(self, salt: str, at=None) -> Column:
        return unit(self.seed, F.lit(salt), F.col("id"), *([] if at is None else [at]))

    def below(self, salt: str, n: int, at=None) -> Column:
        """A whole number from 0 to n - 1."""
        return F.floor(self.unit(salt, at) * n).cast("int")

    def text(self, value: str) -> Column:
        return F.lit(value)

    def field(self, name: str) -> Column:
        return F.col(name)

    def lower(self, x: Column) -> Column:
        return F.lower(x)

    def upper(self, x: Column) -> Column:
        return F.upper(x)

    def cat(self, *parts: Column) -> Column:
        return F.concat(*parts)

    def pick(self, salt: str, options, at=None) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), self.below(salt, len(options), at) + 1)

    def number(self, salt: str, n: int, low: int = 0, at=None) -> Column:
        return (self.below(salt, n, at) + low).cast("string")

    def many(self, salt: str, low: int, n: int, each) -> Column:
        """From low to low + n - 1 texts, one after another; each gets its place."""
        return F.array_join(F.transform(F.sequence(F.lit(1), self.below(salt, n) + low), each), "")

    def letters(self, salt: str, low: int, n: int, *alphabets: str) -> Column:
        """Characters drawn from the alphabets in turn."""
        at = lambda i, a: F.substring(F.lit(a), self.below(f"{salt}.{len(a)}", len(a), i) + 1, F.lit(1))
        return self.many(salt, low, n, lambda i: at(i, alphabets[0]) if len(alphabets) == 1 else F.when(i % 2 == 1, at(i, alphabets[0])).otherwise(at(i, alphabets[1])))

    def choose(self, salt: str, *options: Column) -> Column:
        out = options[-1]
        for k in range(len(options) - 2, -1, -1):
            out = F.when(self.below(salt, len(options)) == k, options[k]).otherwise(out)
        return out

    def chance(self, salt: str, share: float, yes: Column, no: Column, at=None) -> Column:
        return F.when(self.unit(salt, at) < share, yes).otherwise(no)

    def times(self, x: Column, salt: str, low: int, n: int) -> Column:
        return F.repeat(x, self.below(salt, n) + low)

    def spelled(self, x: Column, salt: str, share: float) -> Column:
        """Each letter in capitals with a chance."""
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: self.chance(salt, share, F.upper(F.substring(x, i, F.lit(1))), F.substring(x, i, F.lit(1)), i)), "")

    def replaced(self, x: Column, old: str, new: str) -> Column:
        return F.translate(x, old, new)


def legit_kinds(g) -> dict:
    """Local parts of honest sign-ups by kind: near misses, dated ones, plain ones."""
    f, last = g.lower(g.field("first")), g.lower(g.field("last"))
    mark, year = g.pick("mark", (".", "-", "_")), g.number("year", 51, 1960)
    return {
        "near": g.cat(f, g.text("."), last, mark, g.pick("tag", ("team", "office", "shop", "home", "news")), mark, g.number("near", 9000, 1000)),
        "dated": g.choose("dated", g.cat(f, g.text("."), last, year), g.cat(f, last, year), g.cat(last, g.text("_"), f, year), g.cat(f, year)),
        "plain": g.choose("plain", g.cat(f, g.text("."), last), g.cat(f, last, g.number("small", 100)), g.cat(f, g.text("_"), last), g.cat(last, g.text("."), f), g.cat(f, g.number("office", 900, 100)))}


def fraud_kinds(g) -> dict:
    """Local part and domain of each kind of fraud; a kind without a domain of its own has an ordinary one."""
    f, last, d = g.lower(g.field("first")), g.lower(g.field("last")), g.field("domain")
    word, digit = g.pick("word", ("user", "test", "mail", "demo", "account", "info")), g.number("digit", 10)
    named = g.choose("named", g.cat(f, g.text("."), last), g.cat(f, last), g.cat(f, g.text("_"), last), g.cat(f, g.number("two", 100)))
    hexes = lambda salt, n: g.letters(salt, n, 1, HEX)
    spelled, heavy = g.spelled(word, "case", 0.5), g.number("heavy", 900_000, 100_000)
    syllable = lambda i: g.cat(g.chance("loud", 0.4, g.upper(g.pick("syllable", SYLLABLES, i)), g.pick("syllable", SYLLABLES, i), i), g.chance("extra", 0.3, g.number("extra.digit", 10, at=i), g.text(""), i))
    cluster = lambda i: g.cat(g.pick("cluster", ("rtk", "zgd", "vqp", "jxb", "wfz", "kzm", "dqv"), i), g.chance("cut", 0.4, g.number("cut.digit", 10, at=i), g.text(""), i))
    address = g.cat(*[x for k in range(4) for x in (g.text("-"), g.number(f"ip{k}", 220, 10))])
    return {
        "sequential": (g.cat(g.pick("base", ("user", "test", "admin", "mail", "info", "support", "contact")), g.number("n", 10_000)), d),
        "gibberish": (g.letters("gibberish", 6, 7, CONSONANTS, VOWELS), d),
        "alphanumeric": (g.letters("alphanumeric", 6, 8, LETTERS + "0123456789"), d),
        "hex": (g.letters("hex", 8, 12, HEX), d),
        "uuid": (g.choose("uuid", g.cat(hexes("u1", 8), g.text("-"), hexes("u2", 4), g.text("-"), hexes("u3", 4)), g.cat(hexes("u1", 8), g.text("-"), hexes("u2", 4)), g.cat(g.text("user-"), hexes("u1", 8))), d),
        "base64": (g.cat(g.letters("base64", 8, 8, LETTERS.upper() + LETTERS + "0123456789"), g.pick("pad", ("", "", "=", "=="))), d),
        "consonants": (g.many("clusters", 2, 3, cluster), d),
        "dated": (g.cat(g.choose("dated", g.cat(f, g.text("."), last), g.cat(f, last), g.cat(f, g.text("_"), last), last), g.number("year", 51, 1960)), d),
        "disposable": (named, g.pick("throwaway", THROWAWAY)),
        "plus": (g.cat(g.choose("stem", g.cat(f, g.text("."), last), g.cat(f, last), f), g.text("+"), g.pick("tagged", ("test", "spam", "list", "web", "news"))), d),
        "keyboard": (g.pick("walk", ("qwerty", "asdfgh", "zxcvbn", "qazwsx", "123qwe", "qwertyuiop", "1q2w3e4r", "asd123")), d),
        "repeated": (g.choose("repeated", g.cat(g.times(g.letters("one", 1, 1, LETTERS), "long", 4, 4), g.number("rn", 10_000)), g.times(g.letters("one", 1, 1, LETTERS), "long", 4, 4), g.cat(word, g.times(digit, "four", 4, 1)), g.cat(f, g.times(digit, "three", 3, 1))), d),
        "mixed_case": (g.choose("mixed", spelled, g.cat(spelled, g.number("mixed.n", 1000)), g.cat(spelled, g.number("mixed.n", 1000), spelled)), d),
        "heavy_number": (g.choose("heavier", g.cat(heavy, word), g.cat(word, heavy), heavy, g.cat(word, heavy, word)), d),
        "typosquat": (named, g.pick("lookalike", LOOKALIKES)),
        "vpn": (g.cat(g.pick("marker", ("vpn", "relay", "hop", "gate")), address, g.text("-"), g.number("port", 999)), g.pick("tunnel", TUNNELS)),
        "homoglyph": (g.replaced(g.cat(f, g.text("."), last), *DOUBLES), d),
        "ai_gibberish": (g.many("syllables", 3, 4, syllable), g.pick("ai", (*THROWAWAY, *TUNNELS)))}


def synthetic_dataset(spark: SparkSession, count: int | None = None, legit_ratio: float = 0.5, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """Id, email, name, label, source, kind of made-up sign-ups, of `count` ids or those of a frame with a column id.

    Each row follows from its id and the seed by MD5 alone, on any number of partitions. Three kinds are honest (20 % near misses, 15 % with a
    year), 18 are frauds that come with their weights; 40 % have no name.
    """
    g = Columns(seed)
    df = (spark.range(count) if ids is None else ids.select(F.col("id").cast("long").alias("id"))).select(
        "id", (g.unit("legit") < legit_ratio).alias("legit"), g.unit("roll").alias("roll"), (g.unit("kind") * sum(w for _, w in FRAUD_WEIGHTS)).alias("weight"),
        g.pick("first", FIRST).alias("first"), g.pick("last", LAST).alias("last"), g.pick("domain", DOMAINS).alias("domain"), (g.unit("name") < NO_NAME).alias("nameless"))
    kind, reach = F.lit(FRAUD_WEIGHTS[-1][0]), sum(w for _, w in FRAUD_WEIGHTS)
    for name, weight in reversed(FRAUD_WEIGHTS):
        reach -= weight
        kind = F.when(F.col("weight") < reach + weight, name).otherwise(kind)
    honest = F.when(F.col("roll") < NEAR_MISS, "near").when(F.col("roll") < NEAR_MISS + DATED_LEGIT, "dated").otherwise("plain")
    df = df.withColumns({"kind": F.when(~F.col("legit"), kind), "honest": F.when(F.col("legit"), honest)})
    email = None
    for name, local in legit_kinds(g).items():
        made = F.concat(local, F.lit("@"), F.col("domain"))
        email = F.when(F.col("honest") == name, made) if email is None else email.when(F.col("honest") == name, made)
    for name, (local, domain) in fraud_kinds(g).items():
        email = email.when(F.col("kind") == name, F.concat(local, F.lit("@"), domain))
    source = F.when(F.col("kind").isNotNull(), "synthetic_fraud").when(F.col("honest") == "near", "synthetic_near_legit").when(F.col("honest") == "dated", "synthetic_dated_legit").otherwise("synthetic_legit")
    return df.select(
        "id", email.alias("email"), F.when(F.col("nameless"), F.lit("")).otherwise(F.concat("first", F.lit(" "), "last")).alias("name"),
        F.when(F.col("legit"), "legitimate").otherwise("fraud").alias("label"), source.alias("source"), "kind")
