"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format. DataFrame
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, fresh, join_apart, lower_ascii, written

# What counts as an entity. Runs are possessive or bounded, and begin where no run goes on, so a long
# text without spaces is read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-])"
# First names by script and gender; a name is one of them and a capitalised word after it, or both in capitals.
NAMES = {
    ("latin", "f"): ["Alice", "Anna", "Barbara", "Carmen", "Charlotte", "Claire", "Elena", "Emily", "Emma", "Ingrid", "Julia", "Laura", "Linda", "Lucia", "Maria", "Mary", "Nicole", "Olivia", "Sarah", "Sophie"],
    ("latin", "m"): ["Andrew", "Carlos", "Daniel", "David", "Diego", "George", "Hans", "James", "John", "Luis", "Lukas", "Michael", "Paul", "Peter", "Pierre", "Robert", "Stefan", "Thomas", "Victor", "William"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Александр", "Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
}
# Syllables of made-up family names, by script.
SYLLABLES = {
    "latin": ["bar", "del", "fen", "gor", "hal", "kin", "lom", "mar", "nor", "pel", "ral", "sen", "tor", "vin", "wel", "zan"],
    "cyrillic": ["бар", "вел", "гор", "дан", "кир", "лев", "мор", "нов", "пет", "рос", "сел", "тар", "фад", "хар", "чер", "яр"],
    "greek": ["βαλ", "γερ", "δημ", "ζαχ", "θεο", "καρ", "λαμ", "μαν", "νικ", "παπ", "ρηγ", "σαμ", "ταρ", "φιλ", "χρι", "ψαρ"],
}
FEMALE_ENDING = {"cyrillic": "ова", "greek": "ου", "latin": ""}
MALE_ENDING = {"cyrillic": "ов", "greek": "ος", "latin": ""}
TYPES_OF_DIGITS = ("card", "ssn", "phone")


TYPES = (("email", EMAIL), ("ip", IP), ("card", CARD), ("ssn", SSN), ("phone", PHONE))


def entity_pattern(names: dict[tuple[str, str], list[str]]) -> str:
    """The pattern of all entities, with these first names by script and gender."""
    firsts = [n for some in names.values() for n in some]
    plain = r"(?:" + "|".join(firsts) + r") \p{Lu}\p{Ll}{1,40}+"
    capitals = r"(?:" + "|".join(n.upper() for n in firsts) + r") \p{Lu}{2,40}+"
    return "|".join((EMAIL, IP, CARD, SSN, PHONE, rf"(?<![\p{{L}}\p{{M}}])(?:{plain}|{capitals})(?![\p{{L}}\p{{M}}])"))


def entity_type(value: Column) -> Column:
    """The first of TYPES whose pattern the whole value matches; else a name."""
    out = F.when(value.contains("@"), "email")
    for name, pattern in TYPES[1:]:
        out = out.when(value.rlike(rf"^(?:{pattern})$"), name)
    return out.otherwise("name")


def canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity: letters in lower case; of names all but the first of each word; digits alone of cards, SSNs and phones, whose country code is set apart."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = F.regexp_extract(value, r"^\+([0-9]{1,3})", 1)
    return F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(code, F.lit("|"), F.substring(digits, F.length(code) + 1, F.length(digits)))).when(kind == "email", lower_ascii(value)).otherwise(F.initcap(F.lower(value)))


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a hex digest of 64 bytes, again from its start beyond its end."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(value: Column, digest: Column) -> Column:
    """Each digit and ASCII letter replaced by another of its class; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return (F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1)))
                .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), b % 26 + 1, F.lit(1))).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _picked(parts: Column, digest: Column):
    return lambda i: F.element_at(parts, _byte(digest, i) % 16 + 1)


def _luhn(digits: Column) -> Column:
    """The checksum of digits, 0 if they are a valid card number."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def surrogate(kind: Column, value: Column, key: str, attempt: Column, names: dict[tuple[str, str], list[str]] = NAMES) -> Column:
    """A replacement for a canonical value, from the key, the value and the attempt alone.

    E-mail: local part of the same shape, longer after three attempts in vain, and one domain under example.com, .net or .org for each domain. IP: a dotted
    quad. Card: as many digits, valid by Luhn where the value is. SSN and phone: digits, a phone's country code
    kept; they come into the mention's own format later. Name: a first name of the same gender and script, a made-up family name of the script, a syllable longer after every two attempts, so names never run out.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"), F.sha2(F.concat(F.lit(key), value), 256)), 512)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    domain_digest = F.sha2(F.concat(F.lit(f"{key}|domain|"), domain), 512)
    zone = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(domain_digest, F.lit(63)) % 3 + 1)
    longer = F.substring(digest, F.lit(1), F.least(F.call_function("div", attempt, F.lit(3)), F.lit(60)).cast("int"))
    email = F.concat(_like(local, digest), longer, F.lit("@"), F.lit("m"), F.substring(domain_digest, 1, 10), F.lit(".example."), zone)
    octet = lambda i: (F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % (223 if i == 0 else 256) + (1 if i == 0 else 0)).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    digits = _like(value, digest)
    front = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = (10 - _luhn(F.concat(front, F.lit("0")))) % 10
    card = F.when(_luhn(value) == 0, F.concat(front, check.cast("string"))).otherwise(digits)
    rest = F.substring_index(value, "|", -1)
    phone = F.concat(F.substring_index(value, "|", 1), F.lit("|"), _like(rest, digest))
    first = F.substring_index(value, " ", 1)
    name = None
    for (script, gender), some in names.items():
        own = F.array(*[F.lit(n) for n in some])
        parts = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        length = 3 + F.call_function("div", attempt, F.lit(2)).cast("int")
        syllables = F.transform(F.sequence(F.lit(1), length), _picked(parts, digest))
        ending = (FEMALE_ENDING if gender == "f" else MALE_ENDING)[script]
        made = F.concat(F.element_at(own, _byte(digest, F.lit(0)) % len(some) + 1), F.lit(" "), F.initcap(F.concat(F.array_join(syllables, ""), F.lit(ending))))
        name = F.when(first.isin(some), made) if name is None else name.when(first.isin(some), made)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "name", name).when(kind == "phone", phone).otherwise(digits)


def assign(entities: DataFrame, key: str, names: dict[tuple[str, str], list[str]] = NAMES, vain: int = 30) -> DataFrame:
    """(kind, value, n, surrogate) for distinct entities (kind, value, n): no surrogate is an entity of the corpus, or stands for two.

    Candidates that collide are drawn again, all but the least value's, until none do; each round is written to the
    shared folder. Names and e-mail addresses grow with the attempts. Only a type of fixed digits can have fewer
    surrogates than the corpus has entities: after `vain` rounds in which nothing was assigned that raises an error.
    """
    entities = written(entities.select("kind", "value", "n"), "entities")
    done = None
    open_ = entities.withColumn("attempt", F.lit(0))
    idle = 0
    while idle < vain:
        drawn = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"), names))
        drawn = written(drawn, "surrogates")
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        winner = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).join(taken, ["kind", "surrogate"], "left_anti")
        won = written(winner.join(drawn.select("kind", "value", "n"), ["kind", "value"]).select("kind", "value", "n", "surrogate"), "assigned")
        idle = idle + 1 if won.isEmpty() else 0
        done = won if done is None else written(done.union(won), "assigned")
        open_ = written(drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value", "n", (F.col("attempt") + 1).alias("attempt")), "open")
        if open_.isEmpty():
            return done
    raise ValueError("no free surrogates are left for some entities")


def _in_format(kind: Column, mention: Column, value: Column) -> Column:
    """The surrogate in the format of a mention: its digits fill the mention's digit places."""
    digits = F.replace(value, F.lit("|"), F.lit(""))
    state = lambda out, n: F.struct(out.alias("out"), n.alias("n"))
    filled = F.aggregate(
        F.split(mention, ""), state(F.lit(""), F.lit(0)),
        lambda a, c: F.when(c.rlike("[0-9]"), state(F.concat(a["out"], F.substring(digits, a["n"] + 1, F.lit(1))), a["n"] + 1)).otherwise(state(F.concat(a["out"], c), a["n"])),
        lambda a: a["out"])
    capitals = (kind == "name") & (mention == F.upper(mention))
    return F.when(kind.isin(*TYPES_OF_DIGITS), filled).when(capitals, F.upper(value)).otherwise(value)


def family_names_replaced(text: Column, families: Column) -> Column:
    """The text with bare family names replaced: families maps them to their surrogates. Other texts stay."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(F.map_keys(families), "|"), F.lit(r")(?![\p{L}\p{M}])"))
    new = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.element_at(families, x))
    put = F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.size(families) > 0, put).otherwise(text)


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", names: dict[tuple[str, str], list[str]] = NAMES) -> DataFrame:
    """docs with entities in its text column replaced, plus n_entities and one count for each type (n_email, ...).

    One entity has one surrogate throughout the corpus, under one key; different entities have different ones. A
    name in capitals is the same entity as in small letters. Where a document has a full name, its bare family name,
    in either case, becomes the surrogate's family name (that of the first of several with this family name). Null
    and empty texts stay as they are, with counts of 0; texts of any length are searched whole. Repeated rows are
    treated alike; an empty table gives no rows. The counts get underscores before their names where docs has such columns.
    """
    entity = entity_pattern(names)
    t1, t2 = content_key(F.col(text_col))
    mentions = docs.select(F.col(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(entity), F.lit(0))).alias("pos", "mention"))
    kind = entity_type(F.col("mention"))
    mentions = mentions.distinct().withColumn("kind", kind).withColumn("value", canonical(F.col("kind"), F.col("mention")))
    mentions = written(mentions, "mentions")
    named = join_apart(mentions, assign(mentions.groupBy("kind", "value").agg(F.count("*").alias("n")), key, names), ["kind", "value"], "n")
    named = named.withColumn("new", _in_format(F.col("kind"), F.col("mention"), F.col("surrogate")))
    kinds = [*(name for name, _ in TYPES), "name"]
    family = lambda c: F.substring_index(c, " ", -1)
    both_cases = F.array(F.struct(family(F.col("value")).alias("old"), family(F.col("surrogate")).alias("new")), F.struct(F.upper(family(F.col("value"))).alias("old"), F.upper(family(F.col("surrogate"))).alias("new")))
    per_doc = named.groupBy("doc", "t1", "t2").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "name", F.struct("pos", both_cases.alias("pairs"))))).alias("pairs"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds])
    # The first pair for each family name; a map may have a key only once.
    pairs = F.flatten(F.transform("pairs", lambda x: x["pairs"]))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["old"]))
    per_doc = per_doc.withColumn("pairs", F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda x: x["old"] == k), 1)["new"])))
    d, k1, k2, news, families = fresh(docs, "d", "k1", "k2", "news", "families")
    counts = fresh(docs, *[f"n_{k}" for k in kinds])
    per_doc = per_doc.toDF(d, k1, k2, news, families, *counts)
    h1, h2 = fresh(per_doc, *fresh(docs, "h1", "h2"))
    left = docs.withColumns({h1: t1, h2: t2})
    both = left.join(per_doc, left[id_col].eqNullSafe(per_doc[d]) & (left[h1] == per_doc[k1]) & (left[h2] == per_doc[k2]), "left")
    gaps = F.split(F.col(text_col), entity, -1)
    text = F.when(F.col(news).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.zip_with(gaps, F.col(news), lambda a, b: F.concat(family_names_replaced(a, F.col(families)), F.coalesce(b, F.lit("")))), ""))
    (total,) = fresh(docs, "n_entities")
    n = [F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts]
    return both.select(*[text.alias(c) if c == text_col else left[c] for c in docs.columns], sum(n[1:], n[0]).alias(total), *[x.alias(c) for x, c in zip(n, counts, strict=True)])
