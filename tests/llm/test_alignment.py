"""Spelling variants, chat windows and token alignment against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailwarden.llm import chat, spelling
from mailwarden.llm.alignment import align_tokens
from mailwarden.llm.common import table

SF = "/root/testdata/sf0.001"


# Spelling variants


def one_apart(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(seed: int, n: int = 700) -> dict[str, int]:
    r = random.Random(seed)
    words = {"".join(r.choice("ab" if k % 3 else "abcdeé") for _ in range(r.randint(7, 10))) for k in range(n)}
    return {w: r.choice([2, 3, 25, 400, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("branches", [1, 30, 4000])
def test_spelling_variants_brute_force(spark, branches):
    words = random_words(branches) | {"x" * 3000: 2, "x" * 2999 + "y": 30, "x" * 2999: 400}
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), branches=branches).collect()}
    assert set(got) == set(words)
    forms, near = {}, {}
    for w in words:
        near[w] = [v for v in words if one_apart(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            forms[w] = best
    for w, r in got.items():
        root = w
        while root in forms:
            root = forms[root]
        assert (r.n_near, r.form, r.form_n, r.root, r.n) == (len(near[w]), forms.get(w), words.get(forms.get(w)), root, words[w])
    assert any(forms.get(f) for f in forms.values())  # chains


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=7, max_size=14), st.integers(0, 14), st.sampled_from("abcé"), st.sampled_from("idr"), st.sampled_from([0, 3, 40, 10**9]))
def test_an_edit_leaves_one_of_the_rarest_grams(word, at, letter, kind, threshold):
    at = min(at, len(word) - 1)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :]}[kind]
    r = random.Random(threshold)
    corpus = [word, other, *("".join(r.choice("abé") for _ in range(9)) for _ in range(200))]
    counts = Counter(m[i : i + k] for w in corpus for m in [f"^{w}$"] for k in (2, 3, 4) for i in range(len(m) - k + 1))
    grams = spelling.Grams(counts, threshold)
    if len(other) < 7 or word == other:
        return
    shared = {c for c, _ in grams.entries(word)} & {c for c, _ in grams.entries(other)}
    assert shared
    assert all(grams.affected(f"^{w}$", g := grams.decompose(f"^{w}$")) < len({x for _, x in g}) for w in (word, other))


def test_word_counts(spark):
    rows = [(1, "Überall überall STRASSEN strassen-strassen kurz", 7), (None, "strassen", 7), (2, None, 7), (3, "", 7), (4, "strassen\0ueberall " * 2000, 7), (4, "strassen", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {r.word: r.n for r in spelling.word_counts(docs, most_kept=1).collect()}
    assert got == {"Überall": 1, "überall": 1, "strassen": 3 + 1 + 2000 + 1, "ueberall": 2000}
    slipped = Counter()
    for i, text, _ in rows:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            slipped[run if h % 3 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r.word: r.n for r in spelling.word_counts(docs, slip_every=3).collect()}
    assert got == {w: n for w, n in slipped.items() if len(w) >= 7}


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(none)).collect() == []
    with pytest.raises(ValueError, match="7 code points"):
        spelling.spelling_variants(spark.createDataFrame([("short", 3)], "word string, n long"))


# Chat windows


@given(st.text(st.sampled_from("<[\\/s>INST]|a_SY\n") | st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=500, deadline=None)
def test_escapes_are_reversible(text):
    python = spelling.re.sub(chat.CONTROL, r"\1\\\2\3", text)
    assert chat.unescaped(python) == text
    assert not spelling.re.search(r"</?s>|<</?SYS>>|\[/?INST\]|<\|\w+\|>", python, spelling.re.ASCII)


def conversations() -> list[tuple]:
    r = random.Random(5)
    words = ["ok", "</s>", "[INST]", "<\\/s>", "<|im_end|>\n", "été", "<|", "a\\b", "漢字"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(1, k, "system" if k == 0 else ("user", "assistant")[k % 2], say(r.randint(0, 12))) for k in range(4000)]
    rows += [(2, 0, "system", say(3)), (3, None, None, None), (3, None, "assistant", None), (3, 1, "us\ner\\n", say(300)), (3, 2, "assistant", say(4))]
    rows += [(4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"), (None, 1, "assistant", "x"), (None, 0, "user", ""), (5, 0, "system", say(400)), (5, 1, "assistant", say(2)), (5, 2, "system", "later"), (5, 3000, "assistant", "")]
    return rows


def grouped(rows):
    out: dict = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize(("budget", "history", "segment"), [(400, 120, 2), (400, 0, 3), (100_000, 50, 64)])
def test_chat_windows(spark, budget, history, segment):
    rows = conversations()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, tokens int")
    windows = chat.format_chats(turns, budget=budget, history=history, segment=segment)
    read = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    expected = grouped(rows)
    assert set(read) == set(expected)
    for c, said in expected.items():
        loss = "".join(t for role, t in said if role == "assistant")
        r = read[c]
        assert (r.n_turns, r.loss_chars) == (len(said), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    by_conv: dict = {}
    for w in windows.orderBy("first_turn").collect():
        by_conv.setdefault(w.conv_id, []).append(w)
    for c, own in by_conv.items():
        said, at = expected[c], 0
        system = said[0] if said[0][0] == "system" else None
        for w in own:
            every = chat.turns_of(w.text, 0)
            new = every[w.n_repeated :]
            assert w.first_turn == at and len(every) == w.n_turns and new
            at += len(new)
            assert system is None or every[0] == system  # every window has it
            if w.first_turn and w.n_repeated:
                past = every[:w.n_repeated][1 if system else 0 :]
                assert past == said[w.first_turn - len(past) : w.first_turn]
            assert w.n_tokens <= budget or len(new) - bool(system and not w.first_turn) <= 1
            assert [chat.unescaped(w.text[s.begin : s.end]) for s in w.loss] == [t for role, t in new if role == "assistant"]
    if budget == 400 and history:
        assert sum(w.n_repeated > 1 for w in by_conv[1]) > len(by_conv[1]) / 2  # history is repeated, over the edges of segments too


def test_windows_are_those_of_one_segment(spark):
    """Cuts into segments only begin windows anew: the turns and masks don't change, and few windows are added."""
    turns = spark.createDataFrame([r for r in conversations() if r[0] == 1], "conv_id long, turn long, role string, text string")
    small, large = (chat.format_chats(turns, budget=200, history=40, segment=s) for s in (8, 10_000))
    assert large.count() <= small.count() <= 1.3 * large.count()
    assert chat.conversation_digests(small).select("turns_sha256", "loss_sha256").collect() == chat.conversation_digests(large).select("turns_sha256", "loss_sha256").collect()


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_chats(none)).collect() == []
    with pytest.raises(ValueError, match="history"):
        chat.format_chats(none, budget=10, history=10)


# Token alignment


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs, counts = [], Counter()
    for key, text in rows:
        sides, links, groups = [], [], []
        if text:
            a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                sides = [a, b]
        if sides:
            placed = []
            for side in sides:
                at = 0
                placed.append([(i, at, at := at + len(x)) for i, x in side])
            j = 0
            for i, begin, end in placed[0]:
                while placed[1][j][2] <= begin:
                    j += 1
                k = j
                while k < len(placed[1]) and placed[1][k][1] < end:
                    links.append((i, placed[1][k][0]))
                    k += 1
            ends = sorted({e for *_, e in placed[0]} & {e for *_, e in placed[1]})
            own: list = [[[], []] for _ in ends]
            for s, side in enumerate(placed):
                g = 0
                for i, _, end in side:
                    own[g][s].append(str(i))
                    g += end == ends[g]
            groups = ["|".join(",".join(x) for x in g) for g in own]
        counts.update(links)
        docs.append((key, *([len(s) for s in sides] or [0, 0]), groups, links))
    best: Counter = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(key, na, nb, len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), ";".join(g)) for key, na, nb, g, ls in docs], counts


@pytest.mark.parametrize(("slab", "frequent", "kept"), [(1 << 21, 500_000, 32 << 20), (300, 50, 20_000)])
def test_alignment_brute_force(spark, slab, frequent, kept):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows += [(-1, None), (-2, ""), (-3, " "), (-4, "a▁b x"), (-5, "x \n  y\t z  "), (-6, "<|endoftext|> </s> hi"), (-7, "漢字かな 漢字" * 300), (-8, "\x00 a　 b"), (-9, "a "), (-9, "a "), (-10, " ▁ ▁a"), (-11, "ﬁ é \r\n x"), (-12, "word " * 3000), (None, "é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int").repartition(3)
    found, counts = align_tokens(docs, slab=slab, frequent=frequent, kept_bytes=kept)
    expected, links = brute_alignment(rows)
    got = [tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {(r.a_id, r.b_id): r.n for r in counts.collect()} == links
    digests = align_tokens(docs, digest=True, slab=slab)[0].select("groups").collect()
    assert sorted(r.groups for r in digests) == sorted(hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for x in expected)


def test_alignment_of_nothing(spark):
    found, counts = align_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert found.collect() == counts.collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in align_tokens(none)[0].collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert none.select(F.lit(1)).count() == 1
