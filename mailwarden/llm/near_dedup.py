"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles of five words, banded, and
verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bounded_batches, content_key, fresh, join_apart, texts, written
from .components import connected_components
from .decontamination import SPLIT

BITS = 18  # document frequencies of words are kept for 2**BITS hash values
BLOCK = 1 << 19
RUN = 256  # partners of one text that are verified in one group
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, BASE, dtype=U), np.full(n + 1, inverse, dtype=U)
        up[0] = down[0] = U(1)
        return np.cumprod(up), np.cumprod(down)


class Shingler:
    """Words and shingles of texts as 64-bit hashes, by whole arrays."""

    def __init__(self, size: int = 5):
        self.size = size
        self.up, self.down = _powers(BLOCK * 2)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of a buffer, and where they begin."""
        out, begins, at = [], [], 0
        while at < len(data):
            stop = min(len(data), at + BLOCK)
            if stop < len(data):  # end at a character that is in no word, if the block has one
                cut = max(data.rfind(b" ", at, stop), data.rfind(b"\n", at, stop))
                stop = cut + 1 if cut > at else self._next_gap(data, stop)
            c = np.frombuffer(data[at:stop].translate(SPLIT), dtype=np.uint8)
            if len(c) >= len(self.up):
                self.up, self.down = _powers(len(c))
            inside = np.concatenate([[False], c != 32, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            begin, end = edge[::2], edge[1::2]
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum((c.astype(U) + U(1)) * self.up[: len(c)])])
                out.append(mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(U)))
            begins.append(begin + at)
            at = stop
        if not out:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        return np.concatenate(out), np.concatenate(begins)

    @staticmethod
    def _next_gap(data: bytes, at: int) -> int:
        found = [i for i in (data.find(b" ", at), data.find(b"\n", at)) if i >= 0]
        return min(found) + 1 if found else len(data)

    def of(self, all_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes of several texts, and the text of each."""
        hashes, begins = self.words(b"\n".join(all_texts))
        starts = np.cumsum([0, *(len(t) + 1 for t in all_texts)])[:-1]
        return hashes, np.searchsorted(starts, begins, side="right") - 1

    def shingles(self, hashes: np.ndarray, doc: np.ndarray, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, text, weight), sorted by text and then hash, each once in a text. A text of fewer words than a
        shingle has, but not none, has one of all its words. A weight is the count times the mean idf of the words."""
        k = self.size
        value = idf[(hashes >> U(64 - BITS)).astype(np.int64)]
        sizes = np.bincount(doc, minlength=n)
        with np.errstate(over="ignore"):
            m = max(0, len(hashes) - k + 1)
            full = doc[:m] == doc[k - 1 : k - 1 + m] if m else np.zeros(0, dtype=bool)
            h, w = np.zeros(m, dtype=U), np.zeros(m)
            for i in range(k):
                h = h * BASE + hashes[i : i + m]
                w += value[i : i + m]
            h, w, d = mixed(h[full]), w[full] / k, doc[:m][full]
            short = np.flatnonzero((sizes > 0) & (sizes < k))
            if len(short):
                first = np.searchsorted(doc, short)
                some, mean = [], []
                for f, s in zip(first.tolist(), sizes[short].tolist(), strict=True):
                    x = U(s)
                    for y in hashes[f : f + s]:
                        x = x * BASE + y
                    some.append(x)
                    mean.append(value[f : f + s].mean())
                h, w, d = np.concatenate([h, mixed(np.array(some, dtype=U))]), np.concatenate([w, mean]), np.concatenate([d, short])
        order = np.lexsort((h, d))
        h, w, d = h[order], w[order], d[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        return h[at], d[at], np.add.reduceat(w, at) if len(at) else w


def samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Improved consistent weighted samples: for each run of shingles (from each of `starts` on), k hashes of 32 bits.

    For sample i a shingle of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its own hash; with
    t = floor(ln w / r + b) the run's sample is the shingle, with its t, of least ln c - r (t - b) - r. Two runs share
    a sample with a probability of their weighted Jaccard similarity.
    """
    out = np.empty((len(starts), k), dtype=np.uint32)
    log_w = np.log(weight).astype(np.float32)
    ends = np.append(starts[1:], len(shingle))
    limit = 1 << 15  # shingles at a time, so that what is worked on stays in a processor's cache
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + limit, side="right")))
            a, b = int(starts[lo]), int(ends[hi - 1])
            best = [np.full((hi - lo, k), np.iinfo(np.uint64).max, dtype=U)]
            for p in range(a, b, limit) if hi == lo + 1 else (a,):
                q = min(b, p + limit) if hi == lo + 1 else b
                h, lw = shingle[p:q], log_w[p:q]
                at = np.zeros(1, dtype=np.int64) if hi == lo + 1 else starts[lo:hi] - a
                found = np.empty((hi - lo, k), dtype=U)
                for i in range(k):
                    x = (h ^ U((seed * 1_000_003 + i) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U(0xBF58476D1CE4E5B9)
                    x ^= x >> U(29)
                    y = x * U(0x94D049BB133111EB)
                    y ^= y >> U(32)
                    r = ((x & U(0xFFFF)).astype(np.float32) + np.float32(0.5)) * (((x >> U(16)) & U(0xFFFF)).astype(np.float32) + np.float32(0.5))
                    r *= np.float32(2.0**-32)
                    np.log(r, out=r)
                    np.negative(r, out=r)
                    np.maximum(r, np.float32(1e-6), out=r)
                    beta = (x >> U(32)).astype(np.float32) * np.float32(2.0**-32)
                    c = ((y & U(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * ((y >> U(32)).astype(np.float32) + np.float32(0.5))
                    c *= np.float32(2.0**-64)
                    np.log(c, out=c)
                    np.negative(c, out=c)
                    np.maximum(c, np.float32(1e-12), out=c)
                    np.log(c, out=c)
                    t = np.floor(lw / r + beta)
                    c -= r * (t - beta + np.float32(1))
                    c += np.float32(64)
                    np.maximum(c, np.float32(0), out=c)
                    key = (c.view(np.uint32).astype(U) << U(32)) | ((h ^ (t.astype(np.int64).astype(U) * BASE)) >> U(32))
                    found[:, i] = np.minimum.reduceat(key, at)
                best.append(found)
            out[lo:hi] = (np.minimum.reduce(best) & U(0xFFFFFFFF)).astype(np.uint32)
            lo = hi
    return out


def word_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have a word of each hash value, over all rows, and the number of documents.

    The table has 2**BITS counters whatever the corpus; words that share a counter share its count. Tasks count
    their own rows; the tables are summed by slices of 4,096 counters.
    """
    step = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, counts, n = Shingler(), np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in blocks(batches, "text", BLOCK):
            hashes, doc = made.of(texts(batch, "text"))
            n += batch.num_rows
            pairs = np.unique((doc.astype(np.int64) << BITS) | (hashes >> U(64 - BITS)).astype(np.int64))
            counts += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array([-1, *range(0, 1 << BITS, step)], pa.int32()),
                pa.array([np.array([n]).tobytes(), *(counts[i : i + step].tobytes() for i in range(0, 1 << BITS, step))], pa.binary())], names=["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema)
    counts, n = np.zeros(1 << BITS, dtype=np.int64), 0
    for r in summed.collect():  # 2**BITS counters, whatever the corpus
        if r.slice < 0:
            n = int(np.frombuffer(r.counts, dtype=np.int64)[0])
        else:
            counts[r.slice : r.slice + step] = np.frombuffer(r.counts, dtype=np.int64)
    return counts, n


def idf_table(counts: np.ndarray, n: int) -> np.ndarray:
    """1 + ln((1 + n) / (1 + count)) / ln(2 + n): between 1 and 2."""
    return 1 + np.log((1 + n) / (1 + np.minimum(counts, n))) / np.log(2 + n)


def signatures(docs: DataFrame, idf, bands: int, rows: int, text_col: str = "text", size: int = 5) -> DataFrame:
    """docs' other columns with `bands` (an array of hashes) and `sample` (16 bits of each sample); both null for a text without words."""
    rest = [c for c in docs.columns if c != text_col]
    (text, out1, out2) = fresh(docs.select(*rest), "text_in", "bands", "sample")
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(out1, T.ArrayType(T.LongType())), T.StructField(out2, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, table = Shingler(size), idf.value
        for batch in blocks(batches, text, BLOCK):
            hashes, doc = made.of(texts(batch, text))
            shingle, of, weight = made.shingles(hashes, doc, table, batch.num_rows)
            here, starts = np.unique(of, return_index=True)
            got = samples(shingle, weight, starts, bands * rows) if len(here) else np.zeros((0, bands * rows), dtype=np.uint32)
            keys: list = [None] * batch.num_rows
            kept: list = [None] * batch.num_rows
            with np.errstate(over="ignore"):
                h = np.zeros((len(here), bands), dtype=U)
                for i in range(rows):
                    h = h * BASE + got[:, i::rows].astype(U) + U(1)
                h = mixed(h).view(np.int64)
            for i, d in enumerate(here.tolist()):
                keys[d] = h[i].tolist()
                kept[d] = got[i].astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=schema.names)

    return docs.select(*rest, F.col(text_col).alias(text)).mapInArrow(run, schema)


def shared_buckets(banded: DataFrame) -> DataFrame:
    """The rows (band, hash, node, ...) whose bucket has more than one node.

    Most buckets have one node. They fall out of range-partitioned and sorted rows, in one pass; only the first and
    the last row of a task stay whatever their neighbours are.
    """

    def not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared = None, True  # the last row so far, and whether it stays
        for batch in batches:
            if not batch.num_rows:
                continue
            band, h = batch.column("band").to_numpy(), batch.column("hash").to_numpy()
            same = (band[1:] == band[:-1]) & (h[1:] == h[:-1])
            joins = held is not None and (held.column("band")[0].as_py(), held.column("hash")[0].as_py()) == (band[0], h[0])
            if held is not None and (shared or joins):
                yield held
            keep = np.concatenate([[joins or held is None], same]) | np.concatenate([same, [False]])
            held, shared = batch.slice(batch.num_rows - 1), bool(keep[-1])
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held

    n = int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["band", "hash", "node"]
    rows = banded.select(*order, *(c for c in banded.columns if c not in order))
    return written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(not_alone, rows.schema), "shared-rows")


def bucket_links(rows: DataFrame, least: float = 0.0) -> DataFrame:
    """Candidate pairs (a, b, run) from rows (band, hash, sample, node): at most two for each row.

    The rows are range-partitioned by bucket, sample and node, so a large bucket spreads over tasks and like
    documents stand next to each other. Each node is paired with the first of its bucket in the task and with the one
    before it, where their samples (strings of 16-bit values) agree in a share of `least` or more; the firsts of a bucket that spans tasks are
    paired with the least of them. `run` numbers stretches of RUN partners of one first, so that they can be dealt to several tasks.
    """
    kind = rows.schema["node"].dataType
    schema = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("a", kind), T.StructField("b", kind), T.StructField("run", T.IntegerType())])

    def alike(x: bytes, y: bytes) -> bool:
        return least <= 0 or float((np.frombuffer(x, dtype=np.uint16) == np.frombuffer(y, dtype=np.uint16)).mean()) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, last, begun, at = None, None, None, 0, 0
        kinds: tuple = ()
        for batch in batches:
            own = batch.column("node").type
            kinds = (pa.int32(), pa.int64(), own, own, pa.int32())
            out: list[tuple] = []
            for k, h, node, sample in zip(*(batch.column(c).to_pylist() for c in ("band", "hash", "node", "sample")), strict=True):
                if (k, h) != key:
                    if begun == 1:  # the task's first bucket may have begun in another task
                        out.append((*key, first[0], None, 0))
                    key, first, last, begun, at = (k, h), (node, sample), None, begun + 1, 0
                elif node != first[0] and (last is None or node != last[0]):
                    if alike(first[1], sample):
                        out.append((k, h, first[0], node, at // RUN))
                        at += 1
                    if last is not None and alike(last[1], sample):
                        out.append((k, h, last[0], node, 0))
                    last = (node, sample)
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=schema.names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, first[0], None, 0), kinds, strict=True)], names=schema.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["band", "hash", "sample", "node"]
    found = written(rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "bucket-links")
    pairs = found.where("b IS NOT NULL").select("a", "b", "run")
    # Two rows for each task at most.
    ends = found.where("b IS NULL").groupBy("band", "hash").agg(F.min("a").alias("hub"), F.collect_set("a").alias("firsts")).where(F.size("firsts") > 1)
    pairs = pairs.union(ends.select(F.col("hub").alias("a"), F.explode("firsts").alias("b"), F.lit(0)))
    return pairs.where("a != b").groupBy("a", "b").agg(F.min("run").alias("run"))


def probable(rows: DataFrame, nodes: DataFrame, bits: int = 25) -> DataFrame:
    """rows (node, ...) that may be among nodes (node): all that are, and few others while nodes are fewer than 2**bits.

    A bitmap of hashes, of 2**bits bits whatever the corpus, is broadcast, so the other rows' texts needn't be shuffled
    to find that out; an exact join of what is left has to follow.
    """
    place = F.pmod(F.xxhash64("node"), F.lit(1 << bits))
    maps = nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
    maps = written(maps, "bitmap")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("map"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("part"))
    return both.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).drop("part", "map")


def dealt_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (a, run, b, payload) for pairs (a, b, run): in each run the row of `a` itself, its b null, comes first and
    those of its partners after it, all in one task. nodes are (node, payload).

    So what `a` carries goes once to each run of its partners, not with each of them.
    """
    own, carried = nodes.columns
    empty = F.lit(None).cast(pairs.schema["b"].dataType).alias("b")
    heads = pairs.select("a", "run").distinct().join(nodes.toDF("a", carried), "a").select("a", "run", empty, carried)
    partners = pairs.join(nodes.toDF("b", carried), "b").select("a", "run", "b", carried)
    return heads.union(partners).repartition("a", "run").sortWithinPartitions("a", "run", "b")


def verified(pairs: DataFrame, nodes: DataFrame, idf, threshold: float, size: int = 5) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, run) whose texts, from nodes (node, text), have a weighted Jaccard similarity of
    the threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, table = Shingler(size), idf.value
        head: tuple = ()
        for batch in blocks(batches, "text", BLOCK // 2):
            bags = Bags(made, table, texts(batch, "text"))
            keep = []
            for i, b in enumerate(batch.column("b").to_pylist()):
                if b is None:
                    head = bags.one(i)
                    keep.append(False)
                else:
                    keep.append(bool(bags.similarity(head, [i])[0] >= threshold - 1e-12))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return dealt_pairs(pairs, nodes).mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


class Bags:
    """The weighted shingles of several texts."""

    def __init__(self, made: Shingler, idf: np.ndarray, all_texts: list[bytes]):
        hashes, doc = made.of(all_texts)
        self.shingle, of, self.weight = made.shingles(hashes, doc, idf, len(all_texts))
        self.edge = np.searchsorted(of, np.arange(len(all_texts) + 1))
        self.total = np.bincount(of, weights=self.weight, minlength=len(all_texts))

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray, float]:
        a, b = self.edge[i], self.edge[i + 1]
        return self.shingle[a:b].copy(), self.weight[a:b].copy(), float(self.total[i])

    def similarity(self, head: tuple[np.ndarray, np.ndarray, float], others: list[int] | np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarities of one text's shingles and those of others, none of them without words."""
        own, weight, total = head
        sizes = [self.edge[i + 1] - self.edge[i] for i in others]
        at = np.concatenate([np.arange(self.edge[i], self.edge[i + 1]) for i in others])
        place = np.minimum(np.searchsorted(own, self.shingle[at]), len(own) - 1)
        low = np.where(own[place] == self.shingle[at], np.minimum(weight[place], self.weight[at]), 0.0)
        both = np.add.reduceat(low, np.cumsum([0, *sizes[:-1]]))
        return both / (total + self.total[np.asarray(others)] - both)


def least_agreement(threshold: float, k: int) -> float:
    """The share of k samples below which a similarity at the threshold is over four standard deviations away."""
    return max(0.0, threshold - 4 * (threshold * (1 - threshold) / k) ** 0.5)


def linked(node: list, part: np.ndarray, sample: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, links) -> list[tuple]:
    """Links that join the parts of some nodes: each node of `left` is compared with those of `right` that are of another part.

    Candidates agree in a share `least` of their samples; links(p, others) tells which of them node p is linked to. The
    likeliest are asked first, and a link makes two parts one, so there are fewer links than nodes.
    """
    part, out = part.copy(), []
    for p in left.tolist():
        others = right[part[right] != part[p]]
        if not len(others):
            continue
        agree = (sample[others] == sample[p]).mean(axis=1)
        others = others[np.argsort(-agree, kind="stable")][: int((agree >= least).sum())]
        while len(others):
            some, others = others[:32], others[32:]
            for q in some[links(p, some)].tolist():
                if part[q] != part[p]:
                    out.append((node[p], node[q]))
                    part[part == part[q]] = part[p]
            others = others[part[others] != part[p]]
    return out


def rest_of_buckets(rows: DataFrame, least: float, linker, block: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """Links (a, b) between a bucket's nodes that are of different parts: rows are (band, hash, n, bytes, node, part,
    sample, payload), n and bytes the bucket's number of nodes and size of payloads. linker(payloads) gives the
    function that tells links apart (see linked).

    Every two parts that a link joins get one, directly or over others. A bucket of more nodes or bytes than a
    block is cut, and each pair of blocks is a group of its own, so no task has to hold a bucket.
    """
    kind, carried = rows.schema["node"].dataType, rows.columns[-1]
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compare(group: pa.Table) -> pa.Table:
        node, own = group.column("node").to_pylist(), group.column("own").to_numpy()
        _, part = np.unique(np.array(list(map(str, group.column("part").to_pylist()))), return_inverse=True)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        out: list[tuple] = []
        if part.max() > 0:
            sample = np.frombuffer(b"".join(group.column("sample").to_pylist()), dtype=np.uint16).reshape(len(node), -1)
            out = linked(node, part, sample, np.flatnonzero(own == i), np.flatnonzero(own == j), least, linker(group.column(carried).cast(pa.binary()).to_pylist()))
        return pa.table({c: pa.array([x[k] for x in out], group.schema.field("node").type) for k, c in enumerate("ab")})

    n_blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes, F.lit(1)))
    cut = rows.withColumn("own", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
    cut = cut.select("band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part", "sample", carried)
    return cut.groupBy("band", "hash", "i", "j").applyInArrow(compare, schema)


def open_buckets(rows: DataFrame, named: DataFrame, compared: int = 2) -> DataFrame:
    """The rows (band, hash, node, bytes, ...) of buckets that have more than one part, but for those of so few nodes
    that all were compared; n and bytes are then the bucket's, `part` the node's component or itself."""
    parts = rows.join(named, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    parts = written(parts, "parts")
    some = parts.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.min("part").alias("p"), F.max("part").alias("q")).where((F.col("p") != F.col("q")) & (F.col("n") > compared)).drop("p", "q")
    found = join_apart(parts.drop("bytes"), written(some, "open-buckets"), ["band", "hash"], "n").withColumnRenamed("total", "bytes")
    return written(found, "open-rows")


def joined_parts(named: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) when more links (a, b) come to components found before."""
    part_of = named.select(F.col("node"), F.col("component").alias("part"))
    for end in ("a", "b"):
        more = more.join(part_of.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    joined = connected_components(more).toDF("component", "whole")
    both = named.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return both.union(joined.join(named, joined["component"] == named["node"], "left_anti").select("component", "whole"))


def with_classes(rows: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """rows (doc_id, node, ...) with class, class_id and class_size; nodes are (node, least_id, copies). Rows without a
    node are classes of their own. Copies and classes with many rows are joined apart."""
    of_node = written(nodes.join(named, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"), "node-classes")
    classes = of_node.groupBy("class").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n"))
    known = join_apart(of_node.select("node", "class", "copies"), written(classes, "classes"), ["class"], "n").select("node", "class", "class_id", "class_size", "copies")
    out = join_apart(rows, written(known, "known-nodes"), ["node"], "copies", "left").drop("copies", "node")
    return out.withColumn("class_id", F.when(F.col("class_size") > 1, F.col("class_id")).otherwise(F.col("doc_id"))).withColumn("class_size", F.coalesce("class_size", F.lit(1)).cast("long"))


def bag_linker(idf, threshold: float, size: int):
    """For rest_of_buckets: texts link at the threshold of weighted Jaccard similarity."""

    def linker(all_texts: list[bytes]):
        bags = Bags(Shingler(size), idf.value, all_texts)
        return lambda p, others: bags.similarity(bags.one(p), others) >= threshold - 1e-12

    return linker


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 14, rows: int = 4, shingle_words: int = 5, large: int = 4096, more_bands: int = 100, more_rows: int = 12) -> DataFrame:
    """(doc_id, class_id, class_size, t1, t2, class): a row for each row of docs.

    A class is a connected component of links between texts whose weighted Jaccard similarity over TF-IDF shingles is
    at least the threshold; class_id is its least doc_id, t1 and t2 are hashes of the row's text, `class` names
    the class's least node. Equal texts are one
    node of the graph however many rows have them, so copies cost no links. Words are runs of letters, digits and
    characters beyond ASCII, A-Z in lower case; a text of fewer words than a shingle has one shingle. Null, empty and
    wordless texts are classes of their own; an empty table gives no rows. A pair at the threshold escapes all bands with a probability of
    (1 - threshold**rows)**bands, 0.0006 by default. Pairs whose samples agree so rarely that a similarity at the
    threshold is over four standard deviations away aren't verified.

    Neighbours in the buckets are linked first, which joins large groups of copies at little cost. Buckets that aren't
    in one class by then are opened: their nodes are compared by samples, and verified, until every two classes that a
    link joins are one. Texts of open buckets with more than `large` nodes, alike but below the threshold, are
    banded anew by more samples, more_rows for each of more_bands (a pair at the threshold escapes with 0.0008), and
    those smaller buckets are opened instead.
    """
    bounded_batches(docs.sparkSession)
    t1, t2 = content_key(F.col(text_col))
    kept = docs.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    counts, n = word_frequencies(kept)
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(counts, n))
    node = F.concat(F.to_binary(F.lpad(F.hex("t1"), 16, "0"), F.lit("hex")), F.to_binary(F.lpad(F.hex("t2"), 16, "0"), F.lit("hex")))
    sized = kept.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    signed = written(signatures(sized, idf, bands, rows, "text", shingle_words), "signatures")
    signed = signed.withColumn("node", F.when(F.col("bands").isNotNull(), node))
    distinct = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("sample").alias("sample"), F.first("bytes").alias("bytes"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    distinct = written(distinct, "nodes")
    samples_ = distinct.select("node", "sample")
    shared = shared_buckets(distinct.select("node", "bytes", F.posexplode("bands").alias("band", "hash")))
    by_node = kept.select(node.alias("node"), "text")

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = written(wanted.distinct(), "wanted-nodes")
        # An inner join: Spark would move a semi-join below the bitmap's, and shuffle all texts for it.
        return written(probable(by_node, wanted).join(wanted, "node").groupBy("node").agg(F.first("text").alias("text")), "texts")

    least = least_agreement(threshold, bands * rows)
    likely = written(bucket_links(shared.join(samples_, "node"), least), "likely")
    found_texts = texts_of(shared.select("node"))
    links = written(verified(likely, found_texts, idf, threshold, shingle_words), "links")
    named = connected_components(links)
    open_ = open_buckets(shared, named)
    again = open_.where(F.col("n") > large).select("node").distinct()
    columns = ["band", "hash", "n", "bytes", "node", "part"]
    todo = open_.where(F.col("n") <= large).select(*columns)
    if not again.isEmpty():
        deep = signatures(found_texts.join(again, "node").withColumn("bytes", F.octet_length("text").cast("long")), idf, more_bands, more_rows, "text", shingle_words)
        deep = shared_buckets(deep.select("node", "bytes", F.posexplode("bands").alias("band", "hash")))
        todo = todo.union(open_buckets(deep, named, 1).select(*columns))
    if not todo.isEmpty():
        more = rest_of_buckets(todo.join(samples_, "node").join(found_texts, "node").select(*columns, "sample", "text"), least, bag_linker(idf, threshold, shingle_words))
        named = joined_parts(named, written(more, "more-links"))
    return with_classes(signed.select("doc_id", "t1", "t2", "node"), distinct.select("node", "least_id", "copies"), named).select("doc_id", "class_id", "class_size", "t1", "t2", "class")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near-duplicates: of each class the row of the least id stays (of equal ids the least text hash;
    of repeated rows one), with all its columns."""
    found = near_duplicate_classes(docs, id_col, text_col, **options)
    k1, k2, kid, kn = fresh(docs, "k1", "k2", "kid", "kn")
    # Of texts that share a class and its least id only the least hash stays; alone in its class, every row does.
    stay = found.where("class_size > 1 AND doc_id <=> class_id").groupBy("class").agg(F.first("class_id").alias("d"), F.min(F.struct("t1", "t2")).alias("t"), F.count("*").alias("n"))
    stay = written(stay.select("d", "t.t1", "t.t2", "n").unionByName(found.where("class_size = 1").select(F.col("doc_id").alias("d"), "t1", "t2", F.lit(1).cast("long").alias("n"))), "stay")
    stay = stay.toDF(kid, k1, k2, kn)
    t1, t2 = content_key(F.col(text_col))
    d1, d2 = fresh(stay, *fresh(docs, "d1", "d2"))
    left = docs.withColumns({d1: t1, d2: t2})
    repeated = stay.where(F.col(kn) > 1).limit(1).count() > 0
    joined = left.join(stay.drop(kn), left[id_col].eqNullSafe(stay[kid]) & (left[d1] == stay[k1]) & (left[d2] == stay[k2]), "left_semi")
    if repeated:  # rows that agree in id and text: one stays
        (at,) = fresh(joined, "ordinal")
        joined = joined.withColumn(at, F.row_number().over(W.partitionBy(id_col, d1, d2).orderBy(F.lit(0)))).where(F.col(at) == 1)
    return joined.select(*docs.columns)
