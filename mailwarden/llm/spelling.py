"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Grams of 2 to 4 symbols are counted over all distinct words; a gram is extended only where it is frequent, so the
dictionary stays small and its grams rare. Each word is decomposed into the longest grams of the dictionary. For every
word the most grams that one edit can affect is bounded; its rarest grams, one more than that, go into the index, each with
the rest of the word on its left and on its right. Near words share a gram that the edit leaves alone, so they meet in a list; words that
meet nobody fall out, the others are verified at the places that their lists leave open.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, bounded_batches, texts, written

#: Grams have 2 symbols at least. At most 4 leave, in words of 7 letters and a mark at each end, one gram that an edit can't affect.
SHORTEST, LONGEST = 2, 4
#: Marks of a word's begin and end; no word has them.
BEGIN, END = "^", "$"
#: Rolling hashes of words: base and prime.
BASE, PRIME = 1_000_003, (1 << 61) - 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, slip_every: int | None = None, most_kept: int = 400_000) -> DataFrame:
    """(word, n): runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with min_chars code points or more.

    `slip_every` plants slips of the pen: a run whose crc32(`<id>:<run>`) it divides loses the code point that the
    crc32's remainder by the run's length names, in every place of that row. Null texts have no words, a null id counts as
    empty. Rows are counted as they are, repeated ones too; whole texts, whatever their length. Other columns aren't read.

    A task keeps the counts of about most_kept words, then passes them on; Spark sums them up.
    """
    bounded_batches(docs.sparkSession)
    run = re.compile(rf"[a-zÀ-ÿ]{{{min_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for batch in blocks(batches, "text"):
            for key, text in zip(texts(batch, "key"), texts(batch, "text"), strict=True):
                begin = zlib.crc32(key + b":")
                for word, n in Counter(run.findall(text.translate(LOWER).decode())).items():
                    if slip_every and not (h := zlib.crc32(word.encode(), begin)) % slip_every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    seen[word] = seen.get(word, 0) + n
                if len(seen) > most_kept:
                    yield passed()
        yield passed()

    keyed = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return keyed.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The gram dictionary: how often each gram begins in a word, and which grams are frequent and so extended."""

    def __init__(self, counts: dict[str, int], threshold: float):
        self.counts = counts
        self.frequent = {g for g, n in counts.items() if n > threshold and len(g) < LONGEST}

    def decompose(self, marked: str) -> list[tuple[int, str]]:
        """(begin, gram) of a word between its marks: at each place the longest gram, without those inside an earlier one."""
        out, reach, last = [], 0, len(marked)
        for p in range(last - SHORTEST + 1):
            q = p + SHORTEST
            while q < last and marked[p:q] in self.frequent:
                q += 1
            if q > reach:
                out.append((p, marked[p:q]))
                reach = q
        return out

    def affected(self, marked: str, grams: list[tuple[int, str]]) -> int:
        """The most different grams that one edit of the word can affect; an upper bound.

        An edit at place a leaves the grams before it alone, up to the first whose extension would have looked at a; and
        those behind it that end too late to lie inside a gram that begins before them, LONGEST symbols from there on.
        Insertions affect no more than replacements do.
        """
        all_grams = {g for _, g in grams}
        ends = [p + len(g) for p, g in grams]
        most = 0
        for a in range(1, len(marked) - 1):
            unsure = max(0, a - LONGEST + 1)
            while unsure + SHORTEST <= a and marked[unsure:a] not in self.frequent:
                unsure += 1
            left = sum(p < unsure for p, _ in grams)
            right = next((i for i, (p, _) in enumerate(grams) if p > a and ends[i] > a + LONGEST), len(grams))
            kept = {g for _, g in grams[:left]}
            kept.update(g for _, g in grams[right:])
            most = max(most, len(all_grams) - len(kept))
        return most

    def entries(self, word: str) -> Iterator[tuple[str, int]]:
        """(list, place) of the word's rarest grams, one more than an edit can affect: the gram with all that stands
        left of it (edits from `place` on are open), and with all that stands right of it (edits before `place`)."""
        marked = BEGIN + word + END
        grams = self.decompose(marked)
        rarest = sorted({g for _, g in grams}, key=lambda g: (self.counts.get(g, 0), g))[: self.affected(marked, grams) + 1]
        chosen = set(rarest)
        for p, g in grams:
            if g in chosen:
                end = p + len(g)
                if end < len(marked):
                    yield "L" + marked[:end], end - 1
                if p > 0:
                    yield "R" + marked[p:], p - 1


def gram_dictionary(words: DataFrame, branches: int = 4000) -> Grams:
    """The frequency-pruned dictionary of a table of distinct words.

    A gram is extended where more than one in `branches` of all places in words begin with it; there are fewer than
    2 * branches such grams, whatever the table's size, and each has one extension for each of some 90 letters at most.
    So the dictionary has a bound, and goes to the driver and with the tasks.
    """
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))
    placed = marked.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - SHORTEST + 1)).alias("p"))
    total = placed.count()
    threshold = total / branches
    counts: dict[str, int] = {}
    frequent: list[str] = []
    for size in range(SHORTEST, LONGEST + 1):
        grams = placed.select(F.col("w").substr(F.col("p"), F.lit(size)).alias("g")).where(F.length("g") == size)
        if size > SHORTEST:
            if not frequent:
                break
            grams = grams.where(F.substring("g", 1, size - 1).isin(frequent))
        found = {r.g: r.n for r in grams.groupBy("g").agg(F.count("*").alias("n")).toLocalIterator()}
        counts.update(found)
        frequent = [g for g, n in found.items() if n > threshold]
    return Grams(counts, threshold)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * BASE + ord(c)) % PRIME
    return h


def open_places(word: str, before: int, since: int) -> list[tuple[int, int, bool]]:
    """(hash without the letter there, place, whether it is the last of equal letters) for the places under `before` and from `since` on."""
    n = len(word)
    prefix, suffix, power = [0] * (n + 1), [0] * (n + 1), 1
    for i, c in enumerate(word):
        prefix[i + 1] = (prefix[i] * BASE + ord(c)) % PRIME
    powers = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        suffix[i] = (ord(word[i]) * power + suffix[i + 1]) % PRIME
        power = power * BASE % PRIME
        powers[n - i] = power
    out = []
    for j in (range(n) if before >= since else (*range(before), *range(since, n))):
        out.append(((prefix[j] * powers[n - j - 1] + suffix[j + 1]) % PRIME, j, j + 1 == n or word[j] != word[j + 1]))
    return out


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["hash", "place", "last", "wid"]
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for wid, word, before, since in zip(*(batch.column(c).to_pylist() for c in ("wid", "word", "before", "since")), strict=True):
            for row in [(_hash(word), -1, False), *open_places(word, before, since)]:
                for column, value in zip(out, (*row, wid), strict=True):
                    column.append(value)
            if len(out[0]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64())], names=names)
                out = ([], [], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64())], names=names)


def near_words(words: DataFrame, branches: int = 4000) -> DataFrame:
    """(a, b, word_a, n_a, word_b, n_b), both ways, for all words of the table (wid, word, n) one inserted, deleted or replaced code point apart.

    Words have 7 code points or more and no mark signs; shorter ones could be affected whole by one edit, so they raise an
    error. Nothing is cut from any list: a list of any size is only counted and joined, its words then meet by what is
    left of them without one open letter, where no more than the alphabet's size meet at one place.
    """
    if words.where((F.length("word") < 2 * LONGEST - 1) | F.col("word").rlike("[$^]")).limit(1).count():
        raise ValueError(f"words need {2 * LONGEST - 1} code points or more, and no {BEGIN} or {END}")
    grams = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, branches))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = grams.value
        for batch in batches:
            rows = [(wid, context, place) for wid, word in zip(batch.column("wid").to_pylist(), batch.column("word").to_pylist(), strict=True) for context, place in dictionary.entries(word)]
            if rows:
                wids, contexts, places = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(wids, pa.int64()), pa.array(contexts, pa.string()), pa.array(places, pa.int32())], names=["wid", "context", "place"])

    index = words.select("wid", "word").mapInArrow(indexed, "wid long, context string, place int")
    index = written(index.select("wid", F.xxhash64("context").alias("list"), F.substring("context", 1, 1).alias("side"), "place"), "gram-index")
    shared = index.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").select("list")
    met = index.join(shared, "list").groupBy("wid").agg(
        F.coalesce(F.max(F.when(F.col("side") == "R", F.col("place"))), F.lit(0)).alias("before"), F.coalesce(F.min(F.when(F.col("side") == "L", F.col("place"))), F.lit(2**31 - 1)).alias("since"))
    meeting = words.join(met, "wid").select("wid", "word", "before", F.least("since", F.length("word")).alias("since"))
    places = meeting.mapInArrow(_placed, "hash long, place int, last boolean, wid long")
    gathered = places.groupBy("hash").agg(F.collect_list(F.struct("place", "last", "wid")).alias("own")).where("size(own) > 1")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for own in batch.column("own").to_pylist():
                by_place: dict[int, list[int]] = {}
                for x in own:
                    by_place.setdefault(x["place"], []).append(x["wid"])
                whole = by_place.pop(-1, [])
                shorter = [(x["wid"], y) for x in own if x["last"] for y in whole]
                for pair in shorter + [(x, y) for same in by_place.values() for i, x in enumerate(same) for y in same[:i]]:
                    a += pair
                    b += pair[::-1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = gathered.select("own").mapInArrow(paired, "a long, b long").distinct()
    sides = {s: words.select(F.col("wid").alias(s), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab"}
    return pairs.join(sides["a"], "a").join(sides["b"], "b").where(F.levenshtein("word_a", "word_b", 1) == 1)


def spelling_variants(counts: DataFrame, min_n: int = 2, ratio: int = 10, branches: int = 4000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of a table (word, n) with n of at least min_n.

    n_near counts the near words (one edit apart). form is the near word of largest n (ties: the smallest in code-point order) if its
    n (form_n) is at least `ratio` times the word's own, else null. root follows forms from the word to the last one; each step multiplies n
    by the ratio, so the steps are few (ratio above 1). Null words and repeated ones must not be in the table (word_counts gives none);
    an empty table gives no rows; other columns aren't read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms end")
    words = written(counts.where(F.col("n") >= min_n).select("word", "n", F.monotonically_increasing_id().alias("wid")), "words")
    near = near_words(words, branches)
    most = near.groupBy("a").agg(F.count("*").alias("n_near"), F.max("n_b").alias("top"), F.first("n_a").alias("n_a"), F.min(F.struct((-F.col("n_b")).alias("least"), F.col("word_b").alias("form"), F.col("b").alias("to"))).alias("first"))
    found = F.col("top") >= ratio * F.col("n_a")
    forms = written(most.select(F.col("a").alias("wid"), "n_near", F.when(found, F.col("first.to")).alias("to"), F.when(found, F.col("first.form")).alias("form"), F.when(found, F.col("top")).alias("form_n")), "forms")
    top = words.agg(F.max("n")).first()[0] or 1
    steps = max(0, math.ceil(math.log2(1 + math.log(max(top, 1)) / math.log(ratio))))
    jumps = forms.where("to IS NOT NULL").select("wid", "to", F.col("form").alias("root"))
    for _ in range(steps):  # each round doubles the steps taken
        onward = jumps.select(F.col("wid").alias("to"), F.col("to").alias("next"), F.col("root").alias("further"))
        jumps = written(jumps.join(onward, "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.coalesce("further", "root").alias("root")), "roots")
    out = words.join(forms.drop("to"), "wid", "left").join(jumps.drop("to"), "wid", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
