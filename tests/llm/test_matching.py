"""Near-dedup, decontamination, quality, surrogates and audio against plain Python; the pipeline from end to end."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailwarden.llm import audio, common, components, decontamination, near_dedup, quality, surrogates

SCHEMA = "doc_id long, text string"


def some_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, some_words(rng, 60)) for i in range(30)]
    for i in range(5):  # one word changed: near; half changed: not
        words = rows[i][1].split()
        words[30] = "changed"
        rows.append((100 + i, " ".join(words).upper() + "!"))
        rows.append((200 + i, " ".join(words[:30]) + " " + some_words(rng, 30)))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (301, rows[0][1]), (302, None), (303, ""), (304, "!!!"), (305, "two words"), (306, "Two Words"), (None, rows[7][1]), (307, some_words(rng, 3000) + " " + "x" * 300_000)]
    return rows


def test_near_dedup_against_all_pairs(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA).withColumn("node", F.lit(1)).withColumn("class_id", F.lit(2))
    got = near_dedup.near_duplicate_classes(df).collect()
    assert len(got) == len(corpus)
    made = near_dedup.Shingler()
    texts = [(t or "").encode() for _, t in corpus]
    h, doc = made.of(texts)
    pairs = np.unique((doc.astype(np.int64) << near_dedup.BITS) | (h >> np.uint64(64 - near_dedup.BITS)).astype(np.int64))
    counts = np.bincount(pairs & ((1 << near_dedup.BITS) - 1), minlength=1 << near_dedup.BITS)
    s, of, w = made.shingles(h, doc, near_dedup.idf_table(counts, len(corpus)), len(corpus))
    bags = [dict(zip(s[of == i].tolist(), w[of == i].tolist(), strict=True)) for i in range(len(corpus))]
    group = list(range(len(corpus)))
    for i in range(len(corpus)):
        for j in range(i):
            low = sum(min(v, bags[j].get(k, 0)) for k, v in bags[i].items())
            total = sum(bags[i].values()) + sum(bags[j].values()) - low
            if total and low / total >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = {}
    for i, (d, _) in enumerate(corpus):
        want.setdefault(group[i], []).append(d)
    assert sorted(map(str, ([r.doc_id, r.class_size] for r in got))) == sorted(str([d, len(want[group[i]])]) for i, (d, _) in enumerate(corpus))
    by_class = {}
    for r in got:
        if r.class_size > 1:
            by_class.setdefault(bytes(r["class"]), []).append(r.doc_id)
    assert sorted(map(lambda x: sorted(map(str, x)), by_class.values())) == sorted(sorted(map(str, v)) for v in want.values() if len(v) > 1)


def test_one_of_each_class_stays(spark, corpus):
    out = near_dedup.one_of_each_class(spark.createDataFrame(corpus, SCHEMA).withColumn("k1", F.lit(1)))
    ids = sorted(str(r.doc_id) for r in out.collect())
    assert out.columns == ["doc_id", "text", "k1"]
    assert ids == sorted(str(d) for d, _ in corpus if d is not None and (d < 100 or 200 <= d < 300 or d in (302, 303, 304, 305, 307)))
    assert near_dedup.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_samples_agree_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    w = rng.uniform(1, 3, 400)
    k = 2000
    x = near_dedup.samples(a[:300], w[:300], np.array([0]), k)
    y = near_dedup.samples(a[100:], w[100:] * np.where(np.arange(300) < 100, 2, 1), np.array([0]), k)
    v = w[100:] * np.where(np.arange(300) < 100, 2, 1)
    low = np.minimum(w[100:300], v[:200]).sum()
    assert abs((x == y).mean() - low / (w[:300].sum() + v.sum() - low)) < 0.04


def test_large_bucket_links_without_all_pairs(spark):
    rows = [(0, 7, bytes([i % 5] * 4), i.to_bytes(4, "big")) for i in range(400)]
    df = spark.createDataFrame(rows, "band int, hash long, sample binary, node binary")
    links = near_dedup.bucket_links(df)
    assert links.count() < 1200
    assert components.connected_components(links).select("component").distinct().count() == 1


@pytest.mark.parametrize("large", [4096, 64])
def test_near_pairs_among_texts_of_one_template(spark, large):
    rng = random.Random(8)
    shared = some_words(rng, 255)
    rows = [shared + " " + some_words(rng, 30) for _ in range(900)]  # any two: below 0.8
    for i in range(100):  # a near copy of each of these: about 0.8
        words = rows[i].split()
        for at in (10 + i, 120 + i, 230 + i % 10, 258 + i % 10, 283):
            words[at] = some_words(rng, 1)
        rows.append(" ".join(words))
    made = near_dedup.Shingler()
    h, doc = made.of([t.encode() for t in rows])
    pairs = np.unique((doc.astype(np.int64) << near_dedup.BITS) | (h >> np.uint64(64 - near_dedup.BITS)).astype(np.int64))
    counts = np.bincount(pairs & ((1 << near_dedup.BITS) - 1), minlength=1 << near_dedup.BITS)
    s, of, w = made.shingles(h, doc, near_dedup.idf_table(counts, len(rows)), len(rows))
    names, at = np.unique(s, return_inverse=True)
    bags = np.zeros((len(rows), len(names)), dtype=np.float32)
    bags[of, at] = w
    low = np.array([np.minimum(bags[i], bags[900 + i]).sum() / np.maximum(bags[i], bags[900 + i]).sum() for i in range(100)])
    want = {(i, 900 + i) for i in np.flatnonzero(low >= 0.8).tolist()}
    assert len(want) > 50
    found = near_dedup.near_duplicate_classes(spark.createDataFrame(list(enumerate(rows)), SCHEMA), large=large).where("class_size > 1").collect()
    got = {}
    for r in found:
        got.setdefault(r.class_id, []).append(r.doc_id)
    got = {tuple(sorted(x)) for x in got.values()}
    assert got <= want and len(got) >= 0.99 * len(want), (len(got & want), len(want))


def test_a_very_common_key_is_joined_apart(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 0), (3, 0), (None, 0)], "k long, v long")
    side = spark.createDataFrame([(1, "a", 3000), (2, "b", 1)], "k long, name string, n long")
    got = common.join_apart(rows, side, ["k"], "n", "left")
    assert sorted(map(str, ((r.k, r.name, r["count"]) for r in got.groupBy("k", "name").count().collect()))) == sorted(map(str, [(1, "a", 3000), (2, "b", 1), (3, None, 1), (None, None, 1)]))
    assert common.join_apart(rows, side, ["k"], "n").count() == 3001
    assert common.join_apart(rows, side.limit(0), ["k"], "n").count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 52: 50}
    assert components.connected_components(edges.limit(0)).count() == 0


def hits(text, items, n=13):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    marked, found = set(), set()
    for i, t in items:
        ws = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for k in range(max(1, len(ws) - n + 1) if ws else 0):
            w = ws[k : k + n]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    marked |= set(range(p, p + len(w)))
                    found.add(str(i))
    return len(words), len(marked), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, some_words(rng, 20)) for i in range(6)] + [(6, "short item here"), (7, "Short-item HERE"), (8, None), (9, ""), (10, "a a a a")]
    docs = [(i, some_words(rng, 40)) for i in range(5)]
    docs += [(10, f"x {items[0][1].upper()} y"), (11, " ".join(items[1][1].split()[:12])), (12, items[2][1].replace(" ", " - ")), (13, "a short item, here. a a a a a a a"), (14, None), (15, ""), (15, ""), (None, items[3][1]),
             (16, some_words(rng, 500) + " short item here"), (17, "a " * 3 + "b a a a a a")]
    d, q = spark.createDataFrame(docs, SCHEMA).withColumn("term", F.lit("t")), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(d, q).collect()
    want = sorted(str((i, *hits(t, items))) for i, t in docs)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    blocks = decontamination.search(decontamination.build_index(d), decontamination.phrases(q), block_bytes=2000)
    assert sorted(str((r.doc_id, r.n_words, sorted(r["items"]))) for r in blocks.collect()) == sorted(str((i, hits(t, items)[0], hits(t, items)[2])) for i, t in docs)
    clean = decontamination.uncontaminated(d, q)
    assert clean.columns == d.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in got if not r.contaminated)
    assert decontamination.contamination(d.limit(0), q).count() == 0
    assert decontamination.contamination(d, q.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red far far blue"), (2, "blue x red"), (3, "red a b c d e blue"), (4, "red"), (5, "end red"), (6, "blue start")], SCHEMA)
    q = spark.createDataFrame([("q", ["red", "blue"])], "item string, terms array<string>")
    got = decontamination.search(decontamination.build_index(d), q, within=4).where(F.size("hits") > 0)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_quality_learns_and_ignores_ids(spark):
    rng = random.Random(2)
    rows = [(i, some_words(rng, 50).capitalize() + "." if i % 3 else some_words(rng, 20).upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    odd = spark.createDataFrame([(None, None, None), (1, "", None), (2, "x" * 200_000, None)], df.schema)
    out = quality.score(df.withColumn("score", F.lit(1)).unionByName(odd, allowMissingColumns=True), model).collect()
    assert len(out) == 603 and all(0 <= r._score <= 1 for r in out)
    held = [r for r in out if r.quality is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r._score >= 0.5) == (r.quality == 1) for r in held]) > 0.95
    assert quality.score(df.limit(0), model).count() == 0
    assert 0.55 < model.prior < 0.8  # two thirds, though no label 0 is learned from
    without = quality.train(df.select("doc_id", "text"), df.where("quality = 1").select("doc_id", "quality"))
    assert without.prior == model.prior and np.allclose(without.w1, model.w1)
    twice = df.select("doc_id", "quality").union(df.where("doc_id = 1").selectExpr("doc_id", "0"))
    assert quality.train(df.select("doc_id", "text"), twice).prior <= 1
    assert quality.train(df, df.limit(0).select("doc_id", "quality")).prior == 0.5
    assert quality.accepted(df, model).columns == df.columns


def test_pu_risk_and_its_gradient():
    rng = np.random.default_rng(5)
    for prior, shift in ((0.3, 0.0), (0.8, 2.0), (0.8, -2.0)):
        gp, gu = rng.normal(size=7), rng.normal(size=9) + shift
        plain = prior * np.mean([1 / (1 + math.exp(g)) for g in gp]) + max(0, np.mean([1 / (1 + math.exp(-g)) for g in gu]) - prior * np.mean([1 / (1 + math.exp(-g)) for g in gp]))
        assert quality.pu_risk(gp, gu, prior) == pytest.approx(plain)
        dp, du = quality.pu_steps(gp, gu, prior)
        part = lambda a, b: quality.sigmoid(b).mean() - prior * quality.sigmoid(a).mean()  # noqa: E731, B023
        if part(gp, gu) >= 0:
            goal = lambda a, b: quality.pu_risk(a, b, prior)  # noqa: E731, B023
        else:
            goal = lambda a, b: -part(a, b)  # noqa: E731, B023
        for x, d, at in ((gp, dp, 0), (gu, du, 1)):
            for i in range(len(x)):
                up, down = x.copy(), x.copy()
                up[i] += 1e-6
                down[i] -= 1e-6
                sides = [(up, gu), (down, gu)] if at == 0 else [(gp, up), (gp, down)]
                assert d[i] == pytest.approx((goal(*sides[0]) - goal(*sides[1])) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_is_estimated_without_negatives(prior):
    rng = np.random.default_rng(6)
    positive, negative = rng.normal(1.5, 1, (3000, 6)), rng.normal(-1.5, 1, (3000, 6))
    unlabelled = np.where(rng.random(3000)[:, None] < prior, rng.normal(1.5, 1, (3000, 6)), negative)
    assert abs(quality.estimated_prior(positive, unlabelled) - prior) < 0.08
    model = quality.fit_nnpu(positive, unlabelled, prior)
    assert (model.scores(rng.normal(1.5, 1, (500, 6))) >= 0.5).mean() > 0.95 and (model.scores(negative) < 0.5).mean() > 0.95


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs.where(quality.remainder(F.col("doc_id"), 3) == 1), model).join(labels, "doc_id").select("score", "quality").collect()
    ones, zeros = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros]) > 0.95


def test_surrogates_are_consistent_and_distinct(spark):
    rows = [
        (1, "Write to Anna.Lee@mail.example.com or +1 (614) 555-8001, card 4111 1111 1111 1111, from 10.1.2.3."), (2, "anna.lee@MAIL.example.com and +1 614 555 8001 and 4111-1111-1111-1111, SSN 078-05-1120"),
        (3, "Maria Lopez met Дмитрий Петров and Ελένη Παππά"), (4, None), (5, ""), (6, "no data here, only words 12 and v1.2.3"), (1, "same id, 10.1.2.3"), (7, "mail.10.1.2.3 x" + "a" * 200_000 + "@b.com")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_email", F.lit(0))
    out = {(r.doc_id, i): r for i, r in enumerate(surrogates.replace_pii(df, "k").orderBy("doc_id", "text").collect())}
    by = {r.doc_id: r for r in out.values() if not (r.doc_id == 1 and r.text.startswith("same"))}
    one, two, three = by[1].text, by[2].text, by[3].text
    mail = re.search(r"\S+@\S+", one)[0]
    assert mail.lower() == re.search(r"\S+@\S+", two)[0].lower() and "lee" not in mail
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(re.search(r"\+1 \(\d+\) \d+-\d+", one)[0]) == digits(re.search(r"\+1 \d+ \d+ \d+", two)[0]) != "16145558001"
    card = digits(re.search(r"card ([\d ]+)", one)[1])
    assert card == digits(re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", two)[0]) != "4111111111111111"
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(card)))) % 10 == 0
    same = next(r for r in out.values() if r.doc_id == 1 and r.text.startswith("same"))
    assert re.search(r"\d+\.\d+\.\d+\.\d+", one)[0] == re.search(r"\d+\.\d+\.\d+\.\d+", same.text)[0] != "10.1.2.3"
    first, rus, greek = re.match(r"(\S+) \S+ met (\S+) \S+ and (\S+) \S+", three).groups()
    assert first in surrogates.NAMES["latin", "f"] and rus in surrogates.NAMES["cyrillic", "m"] and greek in surrogates.NAMES["greek", "f"]
    assert by[4].text is None and by[5].text == "" and by[6].text == rows[5][1] and by[6].n_entities == 0
    assert by[1].n_entities == 4 and by[2].n_ssn == 1
    assert surrogates.replace_pii(df.limit(0), "k").count() == 0


def test_colliding_surrogates_are_drawn_again(spark):
    ents = spark.createDataFrame([("ssn", f"{i:02d}", 1) for i in range(60)], "kind string, value string, n long")
    got = surrogates.assign(ents.where("value < '30'"), "k").collect()
    assert len(got) == 30 and len({r.surrogate for r in got}) == 30 and not {r.surrogate for r in got} & {r.value for r in got}


def test_names_never_run_out(spark):
    few = {("latin", "f"): ["Anna"]}
    ents = spark.createDataFrame([("name", f"Anna X{i}", 1) for i in range(9000)] + [("email", f"{c}@b.com", 1) for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, value string, n long")
    got = surrogates.assign(ents, "k", few).collect()
    assert len(got) == 9026 and len({(r.kind, r.surrogate) for r in got}) == 9026
    with pytest.raises(ValueError):
        surrogates.assign(spark.createDataFrame([("ssn", str(i), 1) for i in range(10)], "kind string, value string, n long"), "k", vain=3)


def test_surrogates_against_plain_python(spark):
    import regex

    rng = random.Random(9)
    people = [f"{rng.choice(rng.choice(list(surrogates.NAMES.values())))} {rng.choice(['Lopez', 'Brown', 'Петров', 'Παππά', 'Smith'])}" for _ in range(12)]
    pool = [*people, *(p.upper() for p in people), *(p.split()[1] for p in people), "Lopezian", "a.b@mail.org", "A.B@MAIL.org", "10.20.30.40", "4111 1111 1111 1111", "4111-1111-1111-1112", "078-05-1120", "+1 614 555 8001", "(614) 555-8001", "plain", "words.", "12", "é"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(150)] + [(150, None), (151, "")]
    pattern = regex.compile(surrogates.entity_pattern(surrogates.NAMES))
    out = {r.doc_id: r for r in surrogates.replace_pii(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    full = lambda m: regex.sub(r"[^0-9]", "", m) if regex.search(r"[0-9]", m) else m.lower()
    new_of, old_of = {}, {}
    for i, t in rows:
        if not t:
            assert out[i].text == t and out[i].n_entities == 0
            continue
        old, new = ([m[0] for m in pattern.finditer(x)] for x in (t, out[i].text))
        assert len(old) == len(new) == out[i].n_entities
        for a, b in zip(old, new, strict=True):
            kind = "@" if "@" in a else "digit" if regex.search("[0-9]", a) else "name"
            assert new_of.setdefault((kind, full(a)), full(b)) == full(b) != full(a)
            assert old_of.setdefault((kind, full(b)), full(a)) == full(a)
            assert kind == "@" or regex.sub("[0-9]", "0", a) == regex.sub("[0-9]", "0", b) or kind == "name" or "." in a
            assert kind != "name" or (a == a.upper()) == (b == b.upper())
        families = {}
        for a, b in zip(old, new, strict=True):
            if not regex.search("[0-9@]", a):
                families.setdefault(a.split()[1].lower(), b.split()[1].lower())
        want = []
        for part in pattern.split(t):
            want.append(regex.sub(r"(?<![\p{L}\p{M}])\p{L}+(?![\p{L}\p{M}])", lambda m: families.get(m[0].lower(), m[0].lower()) if m[0][0].isupper() and (m[0][1:].islower() or m[0].isupper()) else m[0].lower(), part).lower())
        assert [x.lower() for x in pattern.split(out[i].text)] == want


def test_recordings_align(spark):
    rng = np.random.default_rng(4)
    tone = lambda n: ((np.sin(np.cumsum(rng.choice([0.2, 0.35, 0.5, 0.9], n // 256).repeat(256))) + 1) * 127).astype(np.uint8).tobytes()
    a, b = tone(16_384), tone(16_384)
    rows = [(1, a), (2, a), (3, bytes(a[1024:])), (4, a[:-2000]), (5, b), (6, None), (7, b""), (8, b"short"), (8, b"short"), (None, b)]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in rows], "doc_id long, audio binary")
    got = {(r.doc_id, r.class_id, r.class_size) for r in audio.recording_classes(df.withColumn("codes", F.lit(1)), frame=128, hop=64).collect()}
    assert got == {(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 1, 4), (5, 5, 2), (None, 5, 2), (6, 6, 1), (7, 7, 1), (8, 8, 2)}
    shift, wrong, n = audio.align(audio.fingerprint(a, 128, 64), audio.fingerprint(a[1024:], 128, 64))
    assert (shift, wrong) == (-16, 0.0) and n > 100
    assert audio.align(audio.fingerprint(a), audio.fingerprint(b))[1] > 0.1
    assert audio.recording_classes(df.limit(0)).count() == 0


def test_offset_votes_against_direct_counts():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (9, 20), (40, 13)):
        a, b = (rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) for k in (n, m))
        b[: min(n, m)] = a[: min(n, m)] ^ np.uint32(1)
        want = []
        for o in range(1 - n, m):
            lo, hi = max(0, -o), min(n, m - o)
            want.append(32 * (hi - lo) - int(np.bitwise_count(a[lo:hi] ^ b[lo + o : hi + o]).sum()))
        assert audio.offset_votes(a, b).tolist() == want
    loop = np.tile(np.arange(4, dtype=np.uint32), 30_000)
    assert audio.align(loop, loop)[:2] == (0, 0.0)


def test_filters_against_direct_sums():
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    frames = audio.chroma(np.frombuffer(data, dtype=np.uint8), 128, 64)
    around = np.hstack([frames, frames])
    codes = audio.fingerprint(data, 128, 64)
    assert len(codes) == len(frames) - audio.WIDTH + 1
    for t in (0, 5, len(codes) - 1):
        want = 0
        for kind, y, height, width in audio.filters():
            box = lambda t0, t1, p0, p1, t=t: around[t + t0 : t + t1, p0:p1].sum()
            a, b, h2, w2, h3, w3 = y, y + height, y + height // 2, width // 2, max(1, height // 3), max(1, width // 3)
            middle_p, middle_t = box(0, width, a + h3, max(a + h3 + 1, b - h3)), box(w3, max(w3 + 1, width - w3), a, b)
            one, two = [(box(0, width, a, b), box(0, width, b, min(24, b + height))), (box(0, width, a, h2), box(0, width, h2, b)), (box(0, w2, a, b), box(w2, width, a, b)),
                        (box(0, w2, a, h2) + box(w2, width, h2, b), box(0, w2, h2, b) + box(w2, width, a, h2)), (box(0, width, a, b) - middle_p, middle_p), (box(0, width, a, b) - middle_t, middle_t)][kind]
            level = sum(math.log((1 + one) / (1 + two)) > x for x in (-0.1, 0, 0.1))
            want = want << 2 | (level ^ level >> 1)
        assert int(codes[t]) == want


@pytest.mark.parametrize("noise", [2, 5, 10, 20])
def test_noisy_copies_are_candidates(noise):
    rng = np.random.default_rng(noise)
    masks, found = audio.band_masks(40, 11), []
    while len(found) < 60:
        x = (np.sin(np.cumsum(rng.choice([0.2, 0.35, 0.5, 0.9], 16).repeat(256))) + 1) * 110 + 17
        y = np.clip(x + rng.normal(0, noise, len(x)), 0, 255)
        a, b = (audio.fingerprint(z.astype(np.uint8).tobytes(), 128, 64) for z in (x, y))
        if audio.align(a, b)[1] <= 0.1:
            found.append(int((audio.band_hashes(a, masks) == audio.band_hashes(b, masks)).sum()) >= 2)
    assert np.mean(found) >= 0.95


def test_noisy_recordings_are_in_the_classes_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    tones = [(np.sin(np.cumsum(rng.choice([0.2, 0.35, 0.5, 0.9], 16).repeat(256))) + 1) * 110 + 17 for _ in range(25)]
    rows = [(i, np.clip(tones[i % 25] + rng.normal(0, [0, 4, 8][i // 25], 4096), 0, 255).astype(np.uint8).tobytes()) for i in range(75)]
    codes = [audio.fingerprint(x, 128, 64) for _, x in rows]
    group = list(range(75))
    for i in range(75):
        for j in range(i):
            if audio.align(codes[i], codes[j])[1] <= 0.1:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    got = {r.doc_id: r.class_id for r in audio.recording_classes(spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "doc_id long, audio binary"), frame=128, hop=64).collect()}
    pairs = [(i, j) for i in range(75) for j in range(i) if group[i] == group[j]]
    assert all(group[i] == group[j] for i in range(75) for j in range(i) if got[i] == got[j])
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.95


@pytest.mark.parametrize("large", [2048, 16])
def test_links_among_many_unlike_recordings_of_one_bucket(spark, large):
    rng = np.random.default_rng(21)
    tone = lambda n: (np.sin(np.cumsum(rng.choice([0.2, 0.35, 0.5, 0.9], n).repeat(256))) + 1) * 110 + 17
    opening = tone(8)  # the same in all: they share buckets, but not half of their integers
    own = [np.concatenate([opening, tone(16)]) for _ in range(150)]
    rows = [np.clip(x + rng.normal(0, 6 * copy, len(x)), 0, 255).astype(np.uint8).tobytes() for copy in (0, 1) for x in own]
    order = rng.permutation(300).tolist()
    rows = [rows[i] for i in order]
    codes = audio.all_fingerprints(rows, 128, 64)
    pairs = [(i, j) for i in range(300) for j in range(i)]
    links = [x for x, y in zip(pairs, audio.aligning([(codes[i], codes[j]) for i, j in pairs], 0.1), strict=True) if y]
    assert len(links) > 100
    group = list(range(300))
    for i, j in links:
        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "doc_id long, audio binary")
    got = {r.doc_id: r.class_id for r in audio.recording_classes(df, frame=128, hop=64, large=large).collect()}
    assert sum(got[i] != got[j] for i, j in links) <= len(links) // 100
    assert all(group[i] == group[j] for i, j in pairs if got[i] == got[j])


def test_candidates_are_alike_in_all_integers_around_their_anchors(spark):
    rng = np.random.default_rng(12)
    draw = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    base, rows = draw(60), []
    for _ in range(30):  # agree in every third integer only
        rows.append(draw(60))
        rows[-1][::3] = base[::3]
    for _ in range(30):  # and copies with 5 % wrong bits
        rows.append(draw(int(rng.integers(24, 80))))
        rows.append(rows[-1] ^ ((rng.random((len(rows[-1]), 32)) < 0.05) @ (1 << np.arange(32, dtype=np.uint64))).astype(np.uint32))
    nodes = spark.createDataFrame([(i, bytearray(x.astype("<u4").tobytes())) for i, x in enumerate(rows)], "node long, codes binary")
    found = audio.bucket_pairs(audio.anchored(nodes, 40, 11), 0.1).where("b IS NOT NULL").collect()
    got = {tuple(sorted((r.a, r.b))) for r in found}
    assert got == {(i, i + 1) for i in range(30, 90, 2)}


def test_alignments_of_many_pairs_against_one_by_one():
    rng = np.random.default_rng(6)
    pairs = []
    for _ in range(300):
        a, b = (rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) for k in rng.integers(0, 60, 2))
        if len(a) and len(b) and rng.random() < 0.6:
            n, at = min(len(a), len(b)), 0 if rng.random() < 0.5 else min(len(a), len(b)) // 2
            flips = (rng.random((n - at, 32)) < rng.choice([0.05, 0.1, 0.12])) @ (1 << np.arange(32, dtype=np.uint64))
            b[: n - at] = a[at:n] ^ flips.astype(np.uint32)
        pairs.append((a, b))
    want = [audio.align(a, b)[1] <= 0.1 for a, b in pairs]
    assert 30 < sum(want) < 250
    assert audio.aligning(pairs, 0.1).tolist() == want


def test_pipeline_runs_and_each_stage_decides(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    assert 0 < docs.count() < n
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert 0 < final.count() <= docs.count()
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
