"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes are matched by merge_asof, each token's
start to the token that covers it on the other side."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, join_apart, written
from .token_counts import vocabulary_path

#: Stretches of a text that no token of either side reaches across: they begin with a space after a character that is neither white space nor U+2581.
STRETCHES = re.compile(r" *[^ ]+(?:(?<=[\s▁]) +[^ ]*)*| +")
#: Bytes of stretches that go to the libraries as one text.
TOGETHER = 1 << 13


#: How byte-level BPE cuts a text before it merges: the default pattern of the tokenizers library's ByteLevel.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this the two libraries' Unicode tables can't differ.
LATIN = "\u0250"


class ByteLevel:
    """A byte-level BPE of the tokenizers library; special strings are plain text.

    Where merges stand in the order of their ids, ids are ranks, and tiktoken merges Latin text by them to the same tokens at a fraction of
    the time and memory.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel as Pre

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        assert set(byte_of) == set(Pre.alphabet())
        entries = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        own = [entries["".join(m)] for m in merges]
        pre = whole["pre_tokenizer"] or {}
        same = own == sorted(own) and whole["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not whole["model"].get("ignore_merges")
        ranks = {self.bytes[i]: i for i in [*(entries[c] for c in byte_of), *own]}
        self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}) if same and len(ranks) == 256 + len(own) else None

    def encode(self, spaced: list[str]) -> list[list[int]]:
        out: list = [self.fast.encode_ordinary(t) if self.fast and max(t) < LATIN else None for t in spaced]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)([spaced[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class Pieces:
    """A sentencepiece model, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in named):
            raise ValueError("pieces reach across spaces")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.space = [self.sp.piece_to_id("▁")]

    def encode(self, spaced: list[str]) -> list[list[int]]:
        found = self.sp.encode([t[1:] for t in spaced], num_threads=1)
        return [self.space if t == " " else ids for t, ids in zip(spaced, found, strict=True)]


def overlaps(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of a, of b) of the tokens whose ranges overlap. Starts rise over all documents; every document is
    covered without gaps by both sides. Each token start finds the other side's covering token; the union of both directions has all overlaps, each once."""
    a = pd.DataFrame({"at": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    b = pd.DataFrame({"at": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    one = pd.merge_asof(a, b, on="at", by="doc")
    other = pd.merge_asof(b, a, on="at", by="doc")
    other = other[a_start[other["a"].to_numpy()] != other["at"].to_numpy()]  # equal starts have been found already
    return np.concatenate([one["a"].to_numpy(), other["a"].to_numpy()]), np.concatenate([one["b"].to_numpy(), other["b"].to_numpy()]).astype(np.int64)


def flat(ids: list[list[int]], sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, text number, start, end in bytes) of the tokens of texts that begin at `begins`."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    tokens = np.fromiter((i for own in ids for i in own), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(ids)), counts)
    size = sizes[tokens]
    end = np.cumsum(size)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    before = np.concatenate([[0], end])[first]
    end = end - np.repeat(before, counts) + np.repeat(begins, counts)
    return tokens, doc, end - size, end


class Aligner:
    """Alignments of stretches, each distinct one computed once. Beyond `most` bytes those that came up once, or least often, are forgotten."""

    def __init__(self, a: str, b: str, most: int = 32 << 20):
        self.a, self.b = ByteLevel(vocabulary_path(a)), Pieces(vocabulary_path(b))
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.names = [list(map(str, range(len(side.bytes)))) for side in (self.a, self.b)]
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.used = np.zeros(0, np.int64)  # how often each came up
        self.costs = np.zeros(0, np.int64)  # bytes
        self.counts = np.zeros((0, 5), np.int64)  # tokens of a, of b, groups, links, and whether it is whole
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)  # a's id << 32 | b's id

    def use(self, stretches: np.ndarray) -> None:
        np.add.at(self.used, stretches, 1)

    def make_room(self) -> None:
        """Keep, where all take too much, the most used ones up to a half of that."""
        if self.costs.sum() <= self.most:
            return
        order = np.argsort(-self.used, kind="stable")
        kept = np.sort(order[(self.used[order] > 1) & (np.cumsum(self.costs[order]) <= self.most // 2)])
        size = np.diff(self.first)[kept]
        begin = self.first[kept]
        self.links = self.links[np.repeat(begin - np.concatenate([[0], np.cumsum(size)])[: len(size)], size) + np.arange(size.sum())]
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.counts, self.costs, self.used = self.counts[kept], self.costs[kept], self.used[kept] // 2
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.groups = [self.groups[i] for i in kept.tolist()]

    def learn(self, new: list[str]) -> None:
        """Align stretches that aren't known yet."""
        if not new:
            return
        texts: list[list[str]] = [[]]
        size = 0
        for x in new:
            if size > TOGETHER or texts[-1] and (texts[-1][-1][-1].isspace() or texts[-1][-1][-1] == "▁"):
                texts.append([])
                size = 0
            texts[-1].append(x)
            size += len(x)
        joined = ["".join(t) for t in texts]
        ids = [side.encode(joined) for side in (self.a, self.b)]
        whole = [all(b"".join(map(side.bytes.__getitem__, own[i])) == t for side, own in zip((self.a, self.b), ids, strict=True)) for i, t in enumerate(x.encode() for x in joined)]
        if not all(whole) and len(new) > 1:  # those by themselves, so that the others stay whole
            self.learn([x for t, ok in zip(texts, whole, strict=True) if ok for x in t])
            for x in (x for t, ok in zip(texts, whole, strict=True) if not ok for x in t):
                self.learn([x])
            return
        if not all(whole):
            self._add(new, np.zeros((1, 5), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [""])
            return
        order = [x for t in texts for x in t]
        ends = np.cumsum([len(x.encode()) for x in order])
        begins = np.concatenate([[0], np.cumsum([len(t.encode()) for t in joined])[:-1]]).astype(np.int64)
        (ta, da, sa, ea), (tb, db, sb, eb) = (flat(own, sizes, begins) for own, sizes in zip(ids, self.sizes, strict=True))
        common = np.intersect1d(ea, eb, assume_unique=True)
        if np.setdiff1d(ends, common).size:
            raise ValueError("a token reaches across a space")
        la, lb = overlaps(sa, da, sb, db)
        of_a, of_b, of_group = (np.searchsorted(ends, e) for e in (ea, eb, common))
        of_link = of_a[la]
        by = np.argsort(of_link, kind="stable")
        n = len(order)
        tables = [np.bincount(x, minlength=n) for x in (of_a, of_b, of_group, of_link)]
        strings = []
        (xa, xb), (na, nb) = ((np.searchsorted(e, common, side="right").tolist() for e in (ea, eb)), self.names)
        wa, wb = [na[i] for i in ta.tolist()], [nb[i] for i in tb.tolist()]
        a0 = b0 = 0
        for a1, b1 in zip(xa, xb, strict=True):
            strings.append(",".join(wa[a0:a1]) + "|" + ",".join(wb[b0:b1]))
            a0, b0 = a1, b1
        edges = np.cumsum(tables[2]).tolist()
        self._add(order, np.stack([*tables, np.ones(n, np.int64)], 1), np.cumsum(tables[3]), ((ta[la] << 32) | tb[lb])[by], [";".join(strings[i:j]) for i, j in zip([0, *edges[:-1]], edges, strict=True)])

    def _add(self, order: list[str], counts: np.ndarray, last: np.ndarray, links: np.ndarray, groups: list[str]) -> None:
        for x in order:
            self.known[x] = len(self.known)
        self.first = np.concatenate([self.first, last + self.first[-1]])
        self.counts = np.concatenate([self.counts, counts])
        self.links = np.concatenate([self.links, links])
        self.groups += groups
        self.costs = np.concatenate([self.costs, np.fromiter((len(x) + len(g) for x, g in zip(order, groups, strict=True)), np.int64, len(order)) + 8 * np.diff(np.concatenate([[0], last])) + 200])
        self.used = np.concatenate([self.used, np.zeros(len(order), np.int64)])


def slabs(text: str, size: int) -> Iterator[str]:
    """A spaced text in parts of about so many characters, cut where stretches begin."""
    begin = 0
    while len(text) - begin > size:
        cut = begin + size
        while 0 <= (cut := text.find(" ", cut)) and (text[cut - 1].isspace() or text[cut - 1] == "▁"):
            cut += 1
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


SCHEMA = "row long, id_value string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, text_col: str, a: str, b: str, digest: bool, slab: int, kept_bytes: int) -> DataFrame:
    """Rows of one table: for each row of docs one with its counts and groups, and its link pairs with how often it has them.
    Long texts have more rows with pairs only (n_a null), so that a row stays small. docs: row, id_value and the text."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(a, b, kept_bytes)

        def summed(docs_of: list[np.ndarray], stretches: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Pairs and times of documents 0 to n - 1, and where each begins."""
            doc, stretch = np.concatenate(docs_of), np.concatenate(stretches)
            many = len(own.groups)
            both, times = np.unique(doc * many + stretch, return_counts=True)
            doc, stretch = both // many, both % many
            begin, size = own.first[stretch], own.first[stretch + 1] - own.first[stretch]
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())
            pairs, number = np.unique(own.links[at], return_inverse=True)
            key = np.repeat(doc, size) * max(len(pairs), 1) + number
            kept, place = np.unique(key, return_inverse=True)
            total = np.bincount(place, np.repeat(times, size), len(kept)).astype(np.int64)
            return pairs[kept % max(len(pairs), 1)], total, np.searchsorted(kept // max(len(pairs), 1), np.arange(n + 1))

        def rows(head: list[tuple], docs_of: list[np.ndarray], stretches: list[np.ndarray]) -> pa.RecordBatch:
            own.use(np.concatenate(stretches))
            pairs, times, edges = summed(docs_of, stretches, len(head))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)]
            columns = [pa.array(c, t) for c, t in zip(zip(*head, strict=True), [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in blocks(batches, "text", 1 << 19):
            head: list[tuple] = []
            docs_of: list[np.ndarray] = [np.zeros(0, np.int64)]
            stretches: list[np.ndarray] = [np.zeros(0, np.int64)]
            own.make_room()
            parts_of = [STRETCHES.findall(" " + t) if t and len(t) < slab else None for t in batch.column("text").to_pylist()]
            own.learn(list({x for parts in parts_of if parts for x in parts if x not in own.known}))
            for i, (row, key, parts) in enumerate(zip(batch.column("row").to_pylist(), batch.column("id_value").to_pylist(), parts_of, strict=True)):
                sums, whole, extra = np.zeros(4, np.int64), True, []
                text_groups = hashlib.sha256() if digest else []
                text = batch.column("text")[i].as_py() or ""
                if not text:
                    head.append((row, key, 0, 0, 0, 0, ""))
                    continue
                long = parts is None
                for k, found in enumerate(map(STRETCHES.findall, slabs(" " + text, slab)) if long else [parts]):
                    if long:
                        if head:
                            yield rows(head, docs_of, stretches)
                            head, docs_of, stretches = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                        own.forget()
                        own.learn(list(set(found)))
                    index = np.fromiter(map(own.known.__getitem__, found), np.int64, len(found))
                    counts = own.counts[index].sum(0)
                    whole = whole and counts[4] == len(index)
                    sums += counts[:4]
                    string = ("" if not k else ";") + ";".join(map(own.groups.__getitem__, index.tolist()))
                    if digest:
                        text_groups.update(string.encode())
                    else:
                        text_groups.append(string)
                    if long:
                        extra.append(rows([(row, None, None, None, None, None, None)], [np.zeros(len(index), np.int64)], [index]))
                if not whole:
                    head.append((row, key, 0, 0, 0, 0, ""))
                    continue
                if not long:
                    docs_of.append(np.full(len(index), len(head), np.int64))
                    stretches.append(index)
                yield from extra
                head.append((row, key, *sums.tolist(), text_groups.hexdigest() if digest else "".join(text_groups)))
                if long:  # what is known now is this text's
                    yield rows(head, docs_of, stretches)
                    head, docs_of, stretches = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                    own.forget()
                    own.learn(list({x for later in parts_of[i + 1 :] if later for x in later}))
            if head:
                yield rows(head, docs_of, stretches)

    return docs.select("row", "id_value", F.col(text_col).alias("text")).mapInArrow(align, SCHEMA)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", digest: bool = False, frequent: int = 500_000, slab: int = 1 << 21, kept_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """The alignment of each row's text by two vocabularies, and how often ids are linked in all rows together.

    Encoded are a space and the text (vocabulary b adds that space itself), without special tokens; their strings are plain text.
    First table, a row for each row of docs: id_col, n_a and n_b (tokens), n_groups and `groups` (`a1,a2|b1;a3|b2,b3`: ids between places where
    tokens of both sides end; with `digest` its SHA-256 in lower-case hex), n_links (pairs of tokens whose bytes overlap), n_best (links whose
    id pair is the most frequent of its b id in all rows, ties included), count_sum (over links, how often their id pair is linked in all rows).
    Second table: a_id, b_id, n, best.

    Null and empty texts, and those whose tokens' bytes differ from the space and the text, have zeros and ''. Rows that share an id, or everything, are counted apart;
    a null id stays null. Whole texts of any length: those over `slab` characters are read in parts, with equal results. An empty table gives empty tables. Other columns aren't read.
    A task computes each distinct stretch between spaces once and keeps up to about kept_bytes of them.
    Id pairs with more than one in `frequent` of all links, fewer than that many, are joined by broadcast.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id_value"), F.col(text_col).alias("text"))
    found = written(aligned(rows, "text", a, b, digest, slab, kept_bytes), "alignment")
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    pairs = links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    pairs = written(pairs, "links")
    best = pairs.groupBy("b_id").agg(F.max("n").alias("most"))
    counts = written(pairs.join(best, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "link-counts")
    joined = join_apart(links, counts, ["pair"], "n", share=frequent)
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    kept = found.where("n_a IS NOT NULL").drop("pairs", "times").join(sums, "row", "left")
    out = kept.select(
        F.col("id_value").cast(docs.schema[id_col].dataType).alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups")
    return out, counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "n", "best")
