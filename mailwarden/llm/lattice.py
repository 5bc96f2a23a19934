"""LM scoring with a subword lattice: scores of an existing unigram vocabulary weight all segmentations of a text,
and a forward recursion in log space sums them to the text's marginal probability."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, blocks, bounded_batches, texts, written
from .quality import remainder
from .token_counts import vocabulary_path

MARK = "▁"  # begins a word, in pieces
LOG10 = math.log(10)


def words(text: bytes) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, cut at ASCII white space."""
    return text.translate(LOWER).split()


def trie(scores: dict[str, float]) -> dict:
    """Pieces by their characters: each maps to a node [score or None, what may follow, 0.0 to count in]."""
    root: dict = {}
    for piece, s in scores.items():
        below = root
        for c in piece[:-1]:
            below = below.setdefault(c, [None, {}, 0.0])[1]
        below.setdefault(piece[-1], [None, {}, 0.0])[0] = s
    return root


class Lattice:
    """Pieces with natural-log scores. Bytes without a piece of their own are covered by byte pieces."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float]):
        self.scores, self.byte_scores = scores, byte_scores
        self.longest = max(map(len, scores), default=1)
        self.root = trie(scores)
        self.by_bytes: dict[str, float] = {}

    def spelled(self, c: str) -> float:
        """The score of a character's byte pieces."""
        s = self.by_bytes.get(c)
        if s is None:
            s = sum(self.byte_scores[b] for b in c.encode())
            if len(self.by_bytes) < 10_000:
                self.by_bytes[c] = s
        return s

    def log_prob(self, text: str) -> float:
        """log of the summed probability of all segmentations of a text into pieces, by forward recursion."""
        root, longest, spelled, exp, log = self.root, self.longest, self.by_bytes.get, math.exp, math.log
        into: deque[list[float]] = deque([] for _ in range(longest))  # terms of the positions after the present one
        alpha = 0.0
        for i, c in enumerate(text):
            s = spelled(c)
            into[0].append(alpha + (self.spelled(c) if s is None else s))
            below, k = root, 0
            for d in text[i : i + longest]:
                node = below.get(d)
                if node is None:
                    break
                s, below, _ = node
                if s is not None:
                    into[k].append(alpha + s)
                k += 1
            terms = into.popleft()
            alpha = terms[0]
            if len(terms) > 1:
                top = max(terms)
                alpha = top + log(sum([exp(t - top) for t in terms]))
            terms.clear()
            into.append(terms)
        return alpha


class Expectation:
    """Expected uses of pieces over all segmentations, by forward and backward sums.

    All segmentations of a text cover the same characters, so probabilities are taken relative to those of single
    characters: the path of single characters weighs 1, and nothing under- or overflows within PART characters.
    Longer texts are taken in such parts.
    """

    PART = 64

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.root = trie({p: math.exp(min(600.0, s - sum(map(self.single, p)))) for p, s in lattice.scores.items() if len(p) > 1})
        self.characters: Counter = Counter()

    def single(self, c: str) -> float:
        """log of the probability of a character by its bytes or its own piece."""
        by_bytes, own = self.lattice.spelled(c), self.lattice.scores.get(c)
        return by_bytes if own is None else own + math.log1p(math.exp(by_bytes - own))

    def add(self, whole: str, times: float) -> None:
        root, longest, characters = self.root, self.lattice.longest, self.characters
        for at in range(0, len(whole), self.PART):
            text = whole[at : at + self.PART]
            n = len(text)
            alpha, rows = [1.0] + [0.0] * n, []
            for i in range(n):
                a, row, below, j = alpha[i], [], root, i
                alpha[i + 1] += a
                for c in text[i : i + longest]:
                    node = below.get(c)
                    if node is None:
                        break
                    w, below, _ = node
                    j += 1
                    if w is not None:
                        alpha[j] += a * w
                        row.append((j, w, node))
                rows.append(row)
            share = times / alpha[n]
            beta = [0.0] * n + [1.0]
            for i in range(n - 1, -1, -1):
                b, a = beta[i + 1], alpha[i] * share
                characters[text[i]] += a * b
                for j, w, node in rows[i]:
                    x = w * beta[j]
                    b += x
                    node[2] += a * x
                beta[i] = b

    def pieces(self) -> dict[str, float]:
        """Expected uses of the pieces of more than one character that were used."""
        found, todo = {}, [("", self.root)]
        while todo:
            before, below = todo.pop()
            for c, (_, more, used) in below.items():
                if used:
                    found[before + c] = used
                todo.append((before + c, more))
        return found

    def uses(self) -> dict[str, float]:
        """By piece; byte pieces by names like those of the vocabulary."""
        found = self.pieces()
        for c, n in self.characters.items():
            own = self.lattice.scores.get(c)
            share = 0.0 if own is None else math.exp(own - self.single(c))
            if share:
                found[c] = found.get(c, 0.0) + n * share
            for b in c.encode():
                found[f"<0x{b:02X}>"] = found.get(f"<0x{b:02X}>", 0.0) + n * (1 - share)
        return found


def word_counts(docs: DataFrame, fold: str = "held_out", text_col: str = "text", most: int = 200_000) -> DataFrame:
    """(word, n, n_train): how often each word occurs in all rows and in those whose `fold` is false.

    Words are counted in each task first, `most` distinct ones at a time, and then summed.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_train", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        train: Counter = Counter()

        def out() -> pa.RecordBatch:
            every.update(train)
            found = pa.RecordBatch.from_arrays([
                pa.array(list(every), pa.binary()).cast(pa.string()), pa.array(every.values(), pa.int64()), pa.array([train.get(w, 0) for w in every], pa.int64())],
                names=["word", "n", "n_train"])
            every.clear()
            train.clear()
            return found

        for batch in blocks(batches, "text", 2 << 20):
            for text, held in zip(texts(batch, "text"), batch.column("held").to_pylist(), strict=True):
                (every if held else train).update(words(text))
            if len(every) + len(train) >= most:
                yield out()
        if every or train:
            yield out()

    kept = docs.select(F.col(text_col).alias("text"), F.col(fold).alias("held"))
    return kept.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def expected_uses(counts: DataFrame, model) -> dict[str, float]:
    """Expected uses of each piece in the training words (word, n_train), over all their segmentations."""
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("uses", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = Expectation(Lattice(*model.value))
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n_train").to_pylist(), strict=True):
                expected.add(MARK + word, n)
        found = expected.uses()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.float64())], names=["piece", "uses"])

    summed = counts.where("n_train > 0").select("word", "n_train").mapInArrow(run, schema).groupBy("piece").agg(F.sum("uses").alias("uses"))
    return {r.piece: r.uses for r in summed.collect()}  # a row for each piece of the vocabulary at most


def vocabulary_scores(pieces: list[tuple[str, float, bool]], offset: int = 10) -> dict[str, float]:
    """A probability for each piece from its score in the vocabulary.

    The given vocabulary's scores are ranks of merges, not logarithms of probabilities: only their order counts. The
    piece of rank r, byte pieces last, gets a share in proportion to 1 / (r + offset), as frequencies of words go by rank.
    """
    order = sorted(pieces, key=lambda x: (x[2], -x[1], x[0]))
    shares = {surface: 1 / (rank + offset) for rank, (surface, _, _) in enumerate(order)}
    total = sum(shares.values())
    return {surface: share / total for surface, share in shares.items()}


def unigram_scores(prior: dict[str, float], uses: dict[str, float], ends: float, strength: float = 3_000.0) -> tuple[dict[str, float], list[float], float]:
    """Natural-log scores of pieces, of bytes, and of a text's end, with probability 1 together: uses and `strength`
    uses more that go by the prior."""
    total = sum(uses.get(p, 0.0) for p in prior) + strength + max(ends, 0.5)
    byte_scores = [0.0] * 256
    scores: dict[str, float] = {}
    for surface, share in prior.items():
        log = math.log((uses.get(surface, 0.0) + strength * share) / total)
        if is_byte(surface):
            byte_scores[int(surface[3:5], 16)] = log
        else:
            scores[surface] = log
    return scores, byte_scores, math.log(max(ends, 0.5) / total)


def is_byte(surface: str) -> bool:
    return len(surface) == 6 and surface.startswith("<0x") and surface.endswith(">")


def vocabulary_pieces(vocabulary: str) -> list[tuple[str, float, bool]]:
    """(surface, score, is byte) of a .model vocabulary, without its control and unknown entries."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
    return [(sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]


def short_key(word: bytes) -> bytes:
    """A word, or for one of over 64 bytes a hash of it that is no word."""
    return word if len(word) <= 64 else b" " + hashlib.blake2b(word, digest_size=20).hexdigest().encode()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2, vocabulary: str = "piece_bpe_32k.model", head_words: int = 100_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of docs.

    The lattice has the pieces of an existing vocabulary. Their probabilities begin as its scores have them
    (vocabulary_scores) and are estimated anew from the training rows, those outside the held-out fold: by the expected
    uses of each piece over all segmentations of the training words. A text's probability is the sum over all its
    segmentations, from a forward recursion in log space; no piece spans two words, so it is the product over its
    words, and of the end: log10 in `score`. All texts' probabilities add up to 1 at most. `base_score` is the add-one
    unigram score over words and one end. A null or empty text is the end alone. Repeated rows are repeated in the
    result and in the counts; an empty table gives no rows.

    Each distinct word is scored once. The most frequent head_words of them go to the tasks by broadcast; a document's
    other words meet their scores in a join.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (remainder(F.col(id_col), folds) == held_out_fold).alias("held_out"))
    counts = written(word_counts(kept), "words")
    ends = kept.where("NOT held_out").count()
    sums = counts.agg(F.sum("n_train").alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
    n, v = (sums.n or 0) + ends, (sums.v or 0) + (ends > 0)
    # Of the size of the given vocabulary, whatever the corpus.
    prior = vocabulary_scores(vocabulary_pieces(vocabulary))
    first = docs.sparkSession.sparkContext.broadcast(unigram_scores(prior, {}, 1.0)[:2])
    scores, byte_scores, end_log = unigram_scores(prior, expected_uses(counts, first), ends)
    model = docs.sparkSession.sparkContext.broadcast((scores, byte_scores))
    word_schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_train", T.LongType()), T.StructField("log10_p", T.DoubleType())])

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            words_ = batch.column("word").to_pylist()
            keys = [short_key(w.encode()) for w in words_]
            out = [lattice.log_prob(MARK + w) / LOG10 for w in words_]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), batch.column("n"), batch.column("n_train"), pa.array(out, pa.float64())], names=word_schema.names)

    scored = written(counts.mapInArrow(score_words, word_schema), "word-scores")
    # head_words rows of a word of 64 bytes at most and two numbers.
    head = scored.orderBy(F.desc("n"), "word").limit(head_words)
    table = head.select("word", "n_train", "log10_p").toArrow()
    spread = math.log10(n + v + 1)
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(
        (w.encode() for w in table.column("word").to_pylist()), zip(table.column("n_train").to_pylist(), table.column("log10_p").to_pylist(), strict=True), strict=True)))
    id_field = kept.schema["doc_id"]
    doc_schema = T.StructType([id_field, kept.schema["held_out"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.StringType()))])

    def score_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = {w: (c > 0, math.log10(c + 1) - spread, p) for w, (c, p) in known.value.items()}
        get = facts.get
        end = (ends > 0, math.log10(ends + 1) - spread, end_log / LOG10)
        for batch in blocks(batches, "text", 2 << 20):
            rows = []
            for text in texts(batch, "text"):
                ws = words(text)
                if max(map(len, ws), default=0) > 64:
                    ws = list(map(short_key, ws))
                found = [f for f in map(get, ws) if f is not None]
                rare = [w.decode() for w in ws if w not in facts] if len(found) < len(ws) else []
                found.append(end)
                seen, base, log10_p = zip(*found, strict=True)
                rows.append((len(ws) + 1, sum(seen), math.fsum(base), math.fsum(log10_p), rare))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.string()))], names=doc_schema.names)

    # Row ids are made where the rows are written, so later stages see the same ones.
    rows = written(kept.mapInArrow(score_heads, doc_schema).withColumn("row", F.monotonically_increasing_id()), "doc-scores")
    tail = rows.select("row", F.explode("rare").alias("word")).join(scored.select("word", "n_train", "log10_p"), "word")
    tail = tail.groupBy("row").agg(
        F.count(F.when(F.col("n_train") > 0, 1)).alias("k"), F.sum(F.log10(F.col("n_train") + 1) - spread).alias("b"), F.sum("log10_p").alias("s"))
    out = rows.drop("rare").join(tail, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"))
