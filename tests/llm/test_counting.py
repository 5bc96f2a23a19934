"""Line dedup, token counts, secret scans, lattice scores and the mix against plain Python."""

import base64
import gzip
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from mailwarden.llm import lattice, line_dedup, mixing, secret_scan, token_counts

SCHEMA = "doc_id long, text string, source string"
LONG = "word " * 40_000
DOCS = [
    (1, "Same Line\nown one\nsame line ", "a"), (2, "same line\n\nown two", "a"), (3, "SAME LINE", None), (3, "SAME LINE", None), (4, None, "b"), (5, "", "b"), (None, "x same line y", "b"),
    (6, LONG, "b"), (7, "café naïve ß\nsame line", "c"), (7, "other text under one id", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup_against_brute_force(spark, docs, none):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = {}
    for i, t, _ in set(DOCS):
        for line in (t or "").split("\n"):
            if key(line):
                found.setdefault(key(line), set()).add((i, t))
    common = {k for k, v in found.items() if len(v) >= 3}
    want = Counter()
    for i, t, _ in DOCS:
        lines = (t or "").split("\n")
        kept = "\n".join(x for x in lines if key(x) not in common)
        want[(i, len(lines), sum(key(x) in common for x in lines), kept)] += 1
    out = line_dedup.dedup_lines(docs.withColumn("k1", docs.doc_id).withColumn("bitmap", docs.doc_id), min_docs=3)
    assert {"k1", "bitmap"} <= set(out.columns)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_keeps_the_first(spark, docs):
    out = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, min_docs=3, keep_first=True).collect()}
    assert (1, "Same Line\nown one") in out
    assert (3, "") in out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_repeated_lines_over_any_number_of_tasks(spark, parts):
    rng = random.Random(parts)
    rows = [(i, "\n".join(rng.choice(["", " all", "ALL", *"abcdefgh", f"own {i}"]) for _ in range(rng.randrange(30)))) for i in range(120)]
    rows += rows[:7] + [(i, "all\nall") for i in range(200, 700)] + [(None, "h\nall")]
    key = lambda x: x.strip().lower()
    seen, places = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for pos, line in enumerate(t.split("\n")):
            if key(line):
                seen.setdefault(key(line), set()).add((i, t))
                places.setdefault(key(line), []).append((i, t, pos))
    common = {k for k, v in seen.items() if len(v) >= 100}
    assert "all" in common
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for keep_first in (False, True):
            gone = {p for k in common for p in places[k][keep_first:]}
            want = Counter((i, t.count("\n") + 1, sum((i, t, p) in gone for p in range(t.count("\n") + 1)), "\n".join(x for p, x in enumerate(t.split("\n")) if (i, t, p) not in gone)) for i, t in rows)
            out = line_dedup.dedup_lines(df, min_docs=100, keep_first=keep_first).collect()
            assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_second_shuffle_of_lines(spark, docs):
    index = line_dedup.line_index(docs)
    plan = line_dedup.repeated_lines(index, 3, False)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan  # what follows the one pass reads its few rows


def test_many_lines_have_bitmaps_in_parts(spark):
    n = 20
    docs = spark.createDataFrame([(i, "\n".join(["x", *[f"{i} {j}" for j in range(n)], "x"])) for i in range(4)], "doc_id long, text string")
    assert {(r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=4).collect()} == {(n + 2, 2)}


def test_token_counts_match_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", "B", "é", "1", "!", "'s", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\x1c", "\x85", "<|endoftext|>", "中", "\u0301"]) for _ in range(60)) for _ in range(200)]
    more = spark.createDataFrame([(8, "a<|endoftext|> b  \n\n  c't 123" * 50, "x"), (8, "".join(rng.choice("aZ09+/='") for _ in range(9000)), "x"), (8, "文字" * 4000, "x"), *[(9, t, "y") for t in odd]], SCHEMA)
    out = token_counts.token_counts(docs.union(more).withColumn("n_tokens", docs.doc_id), batch_bytes=1000, kept_pieces=50)
    for r in out.collect():
        assert r._n_tokens == len(tok.encode(r.text or "", add_special_tokens=False)), r.text
    assert token_counts.token_counts(none).count() == 0


def test_pieces_make_up_the_text():
    text = "  ab  cd\n\nef\x1cgh \xa0x" * 30 + " "
    assert "".join(token_counts.PIECES.findall(text)) == text


SECRET = "password = hunter2hunter2"


@pytest.mark.parametrize("wrap", [
    lambda s: quote(s), lambda s: quote(quote(s)), lambda s: base64.b64encode(s.encode()).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(base64.b64encode(s.encode()))).decode(), lambda s: quote(base64.b64encode(s.encode()).decode()), lambda s: "".join(f"&#x{ord(c):x};" for c in s)])
def test_layers_are_unwrapped_and_spans_mapped_back(wrap):
    inner = wrap(SECRET)
    text = f"ünder {inner} end"
    spans = {s for s in secret_scan.all_spans(text) if s[0] == "assign"}
    assert spans
    assert all(6 <= a < b <= 6 + len(inner) for _, a, b in spans)


def mime(data: bytes, width: int = 76) -> str:
    x = base64.b64encode(data).decode()
    return "\r\n".join(x[i : i + width] for i in range(0, len(x), width))


@pytest.mark.parametrize("inner", [
    base64.b64encode(gzip.compress(b" " * (17 << 20) + SECRET.encode() + b" " * (5 << 20))).decode(),  # behind 17 MB of padding
    base64.b64encode(gzip.compress(gzip.compress(b"\n" * (9 << 20) + SECRET.encode()))).decode(),
    base64.b64encode(b"\x00\x01\xff" + SECRET.encode() + b"\xfe\x00").decode(),  # among other bytes
    base64.b64encode(gzip.compress(b"first member, nothing here") + gzip.compress(SECRET.encode())).decode(),
    base64.b64encode(gzip.compress(SECRET.encode() * 50)).decode()[:-20],  # cut off
    mime(b"a long text goes before it " * 10 + SECRET.encode()), mime(gzip.compress(bytes(random.Random(1).randrange(256) for _ in range(300)) + SECRET.encode()))])
def test_nothing_is_cut(inner):
    text = f"see {inner} end"
    found = [s for s in secret_scan.all_spans(text) if s[0] == "assign"]
    assert found and all(4 <= a < b <= 4 + len(inner) for _, a, b in found)


def test_many_compressed_levels():
    raw = SECRET.encode()
    for _ in range(200):
        raw = zlib.compress(raw)
    assert any(k == "assign" for k, _, _ in secret_scan.all_spans("x " + base64.b64encode(raw).decode()))


@pytest.mark.parametrize("nest", [lambda n: "%" + "25" * n + "3Dhunter2hunter2", lambda n: "\\" + "u005c" * n + "u003dhunter2hunter2", lambda n: "&" + "#38;" * n + "#61;hunter2hunter2", lambda n: "%5cu0025" * 2 + "%" + "5cu0025" * n + "3Dhunter2hunter2"])
def test_deep_nests_take_time_in_proportion(nest):
    import time

    begin = time.time()
    text = "ü password" + nest(1 << 17)
    found = [s for s in secret_scan.all_spans(text) if s[0] == "assign"]
    assert time.time() - begin < 20
    assert any(a == 2 and b == len(text) for _, a, b in found) or "%5c" in text


def test_all_codes_as_one_at_a_time():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["%", "25", "41", "2", "5", "\\", "u0025", "x41", "u", "&#", "37;", "x26;", "é", "z"]) for _ in range(30))
        at = secret_scan.np.arange(len(text) + 1)
        layer, before = secret_scan.Layer(text, at[:-1], at[1:]), None
        got = secret_scan._all_codes(layer)
        assert len(got.text) == len(got.begin) == len(got.end) and (got.begin < got.end).all()
        assert not any(m[1] is not None for m in secret_scan.ONE_CODE.finditer(got.text.encode("latin-1")))
        if "%" not in text.replace("%25", ""):
            continue
        while before != layer.text:  # in whatever order codes are decoded, plain ones end alike
            before = layer.text
            for x in secret_scan._percent(layer):
                layer = x
        if not re.search(r"\\|&#", text) and layer.text.isascii():
            assert got.text == layer.text


def test_cycles_end():
    assert secret_scan.all_spans("%25" * 50 + "%2525252541") is not None


def test_base_spans_against_the_patterns(spark, docs, none):
    text = 'Token: "abc" token="abcdef" AKIA' + "Q" * 16 + " AKIAQ " + "0a" * 12 + " API_KEY=0123456789 ſecret=abcdefgh"
    want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted(secret_scan.scan(text)) == sorted(want)
    rows = secret_scan.scan_secrets(docs.union(spark.createDataFrame([(9, text, "")], SCHEMA))).collect()
    assert len(rows) == len(DOCS) + 1
    got = next(r for r in rows if r.doc_id == 9)
    assert got.base == secret_scan.joined(want) and set(got.base.split(",")) <= set(got.spans.split(","))
    assert next(r for r in rows if r.doc_id == 4).spans == ""
    assert secret_scan.scan_secrets(none).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = {"▁a": -1.0, "▁ab": -2.0, "b": -1.5, "c": -0.7, "bc": -2.2}
    lat = lattice.Lattice(pieces, [-9.0] * 256)

    def every(text):
        if not text:
            return 1.0
        total = sum(math.exp(s) * every(text[len(p):]) for p, s in pieces.items() if text.startswith(p))
        return total + math.exp(-9.0 * len(text[0].encode())) * every(text[1:])

    for text in ("▁abc", "▁abcbc", "▁zé", "▁a"):
        assert lat.log_prob(text) == pytest.approx(math.log(every(text)))


def test_expected_uses_against_all_segmentations():
    pieces = {"▁": -3.0, "a": -2.5, "▁a": -1.0, "▁ab": -2.0, "b": -1.5, "c": -0.7, "bc": -2.2, "abc": -4.0}
    lat = lattice.Lattice(pieces, [-6.0] * 256)

    def every(text):
        if not text:
            yield 1.0, ()
            return
        for p, s in pieces.items():
            if text.startswith(p):
                yield from ((math.exp(s) * x, (p, *rest)) for x, rest in every(text[len(p):]))
        own = tuple(f"<0x{b:02X}>" for b in text[0].encode())
        yield from ((math.exp(-6.0 * len(own)) * x, (*own, *rest)) for x, rest in every(text[1:]))

    expected, want = lattice.Expectation(lat), Counter()
    for text, times in (("▁abc", 3), ("▁abcbc", 1), ("▁zéa", 2)):
        expected.add(text, times)
        ways = list(every(text))
        total = sum(x for x, _ in ways)
        for x, used in ways:
            for p in used:
                want[p] += times * x / total
    got = expected.uses()
    assert {p for p, n in want.items() if n > 1e-9} <= set(got)
    assert all(got.get(p, 0.0) == pytest.approx(n) for p, n in want.items())


def test_vocabulary_scores_keep_their_order_and_sum_to_one():
    pieces = lattice.vocabulary_pieces("piece_bpe_32k.model")
    prior = lattice.vocabulary_scores(pieces)
    assert sum(prior.values()) == pytest.approx(1) and len(prior) == len(pieces)
    plain = sorted((x for x in pieces if not x[2]), key=lambda x: -x[1])
    assert prior[plain[0][0]] > prior[plain[100][0]] > prior[plain[-1][0]]
    scores, by_bytes, end = lattice.unigram_scores(prior, {plain[5][0]: 50.0}, 7)
    assert sum(map(math.exp, [*scores.values(), *by_bytes, end])) == pytest.approx(1)
    assert lattice.Expectation(lattice.Lattice(scores, by_bytes)).add("▁" + "x" * 5000 + "😀" * 300, 1) is None


def test_lattice_scores_and_base_against_brute_force(spark, docs, none):
    out = lattice.score_documents(docs, head_words=3).collect()
    toks = {}
    for i, t, _ in DOCS:
        toks.setdefault((i, t), re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c, ends = Counter(), 0
    for i, t, _ in DOCS:
        if not held(i):
            c.update(toks[i, t])
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = sorted((str(i), len(toks[i, t]) + 1, sum(c[w] > 0 for w in toks[i, t]) + 1, held(i), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[i, t]) + math.log10((ends + 1) / (n + v + 1)), 6)) for i, t, _ in DOCS)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in out)
    assert lattice.score_documents(none).count() == 0
    one = next(r for r in out if r.doc_id == 4)  # the end alone
    two = next(r for r in out if r.doc_id == 2)
    assert two.score < one.score < 0


def test_mix_reaches_targets_and_repeats(spark, docs, none):
    rows = [(i, "w " * (i % 50 + 1) * 8, f"s{i % 4}" if i % 5 else None) for i in range(300)] + DOCS
    df = spark.createDataFrame(rows, SCHEMA)
    out, mixed = mixing.mix(df, block=16)
    got = out.collect()
    assert len(got) == len(rows)
    sizes, weights = Counter(), (3, 1, 2)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:  # cut what is above twice its size, share the rest, until none is
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(target[r.source])
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 33 for s in names)
    assert sum(r.words for r in mixed.collect()) == sum(taken.values())
    again = sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(df.repartition(3), block=16)[0].collect())
    assert again == sorted((str(r.doc_id), r["size"], r.taken) for r in got)
    assert mixing.mix(none)[0].count() == 0
    whole = mixing.mixed_documents(df.withColumn("h", df.doc_id).withColumn("taken", df.doc_id), block=16)
    assert {"h", "taken", "words_taken"} <= set(whole.columns)
    assert whole.agg({"words_taken": "sum"}).first()[0] == sum(taken.values())


def test_slots_permute_a_source(spark):
    targets = spark.createDataFrame([("a", 0, 1000, 2000.0), ("b", 1, 7, 7.0), ("c", 2, 0, 0.0)], "source string, source_no int, source_size long, target double")
    rows = mixing.draw(targets, block=10).collect()
    a = Counter(r["index"] for r in rows if r.source_no == 0)
    assert set(a.values()) == {2} and len(a) == 100
    assert len(rows) == 201
    assert [r["index"] for r in sorted(rows, key=lambda r: r.slot) if r.source_no == 0 and r.epoch == 0] != [r["index"] for r in sorted(rows, key=lambda r: r.slot) if r.source_no == 0 and r.epoch == 1]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000, 4099])
def test_permutations(spark, n):
    x = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
    got = [r.y for r in x.select("id", mixing.permuted(F.col("id"), F.col("n"), F.lit(1)).alias("y")).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert got != [r.y for r in x.select("id", mixing.permuted(F.col("id"), F.col("n"), F.lit(2)).alias("y")).orderBy("id").collect()]
        steps = Counter((b - a) % n for a, b in zip(got, got[1:], strict=False))
        assert max(steps.values()) < 20 and sum(a == i for i, a in enumerate(got)) < 10


def test_shard_counts_are_multinomial_and_number_the_slots(spark):
    targets = spark.createDataFrame([("a", 0, 64_000, 128_000.0), ("b", 1, 64_000, 32_000.0)], "source string, source_no int, source_size long, target double")
    counts = mixing.shard_counts(targets, block=16, shard_words=2_000).collect()
    for no, total in ((0, 8000), (1, 2000)):
        own = sorted((r.shard, r.slot_start, r.n) for r in counts if r.source_no == no)
        assert sum(n for _, _, n in own) == total
        assert [s for _, s, _ in own] == [sum(n for _, _, n in own[:i]) for i in range(len(own))]
        mean = total / 80
        assert 0.6 < sum((n - mean) ** 2 / mean for _, _, n in own) / 79 < 1.5  # chi square of equal shares
    slots = mixing.draw(targets, block=16, shard_words=2_000).groupBy("source_no", "shard").count().collect()
    assert {(r.source_no, r.shard, r["count"]) for r in slots} == {(r.source_no, r.shard, r.n) for r in counts}


def test_repeated_encoded_secrets_each_have_a_span():
    import base64
    import zlib

    for raw in (b"password=hunter2hunter2", zlib.compress(b"password=hunter2hunter2"), base64.b64encode(b"password=hunter2hunter2")):
        part = base64.b64encode(raw).decode()
        text = f"one {part} two {part} end"
        found = sorted((a, b) for k, a, b in secret_scan.all_spans(text) if k == "assign")
        first, second = text.index(part), text.rindex(part)
        assert any(first <= a and b <= second for a, b in found) and any(a >= second for a, _ in found)
