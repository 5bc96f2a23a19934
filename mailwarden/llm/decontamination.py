"""Benchmark decontamination over a distributed positional inverted index.

The index has, for each segment of about a million words and each term, the term's positions. Phrases are found by
intersecting offset-adjusted lists, from a phrase's rarest term on; proximity search uses the same lists.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, blocks, bounded_batches, content_key, fresh, lower_ascii, texts, written

#: A word of the contract, as a Java regular expression over lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of words in lower case; every other byte to a space.
SPLIT = bytes(LOWER[b] if b >= 128 or chr(LOWER[b]).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """Store the postings of docs: (segment, term, n, positions, ids, sizes), written to the shared folder.

    positions are differences of int32 word positions in the segment, where one position stays free after each
    document. The row of term '' lists the segment's documents: their ids and, in `sizes`, their numbers of words.
    Every row of docs is a document of its own; null and empty texts have no words.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("positions", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", segment_bytes):
            ids: defaultdict[bytes, int] = defaultdict()
            ids.default_factory = ids.__len__
            sizes, found = [], []
            for text in texts(batch, "text"):
                ws = words(text)
                sizes.append(len(ws))
                found.append(np.fromiter(map(ids.__getitem__, ws), dtype=np.int32, count=len(ws)))
                found.append(np.array([-1], dtype=np.int32))
            term = np.concatenate(found)
            at = np.flatnonzero(term >= 0).astype(np.int32)
            order = at[np.argsort(term[at], kind="stable")]
            edges = np.concatenate([np.searchsorted(term[order], np.arange(len(ids))), [len(order)]]).astype(np.int32)
            steps = np.diff(order, prepend=np.int32(0))
            steps[edges[:-1]] = order[edges[:-1]]  # each term's list begins anew
            spelled = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            k = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([""]), pa.array([batch.num_rows], pa.int64()), pa.array([b""], pa.binary()),
                pa.array([batch.column("id").to_pylist()], pa.list_(batch.column("id").type)), pa.array([np.array(sizes, dtype=np.int64).tobytes()], pa.binary())], names=schema.names)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k, number, dtype=np.int64)), pa.StringArray.from_buffers(k, pa.py_buffer(spelled), pa.py_buffer(b"".join(ids))), pa.array(np.diff(edges).astype(np.int64)),
                pa.BinaryArray.from_buffers(pa.binary(), k, [None, pa.py_buffer(edges * np.int32(4)), pa.py_buffer(steps)]),
                pa.nulls(k, pa.list_(batch.column("id").type)), pa.nulls(k, pa.binary())], names=schema.names)
            number += 1

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(kept.mapInArrow(run, schema), "postings")


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """(item, terms): each item's windows of n consecutive words; an item of fewer words, but not none, is one window."""
    ws = items.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("ws"))
    ws = ws.where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (n - 1), F.lit(1)))
    return ws.select("item", "ws", F.explode(starts).alias("i")).select("item", F.slice("ws", F.col("i"), n).alias("terms"))


def exact(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Starts of a phrase: (offset, positions) of its terms, the rarest first; lists are moved by their offsets and intersected."""
    starts = lists[0][1] - lists[0][0]
    for offset, positions in lists[1:]:
        if not len(starts):
            break
        i = np.searchsorted(positions, starts + offset)
        i[i == len(positions)] = 0
        starts = starts[positions[i] == starts + offset]
    return starts


def near(lists: list[np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of at most `within` words that have every term, in any order, the rarest list first."""
    starts = np.unique(np.concatenate(lists))
    last = starts.copy()
    for positions in lists:
        i = np.searchsorted(positions, starts)
        ok = i < len(positions)
        starts, last, i = starts[ok], last[ok], i[ok]
        last = np.maximum(last, positions[i])
        ok = last - starts < within
        starts, last = starts[ok], last[ok]
    return starts, last + 1


def search(index: DataFrame, wanted: DataFrame, within: int | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """Match phrases, the rows (item, terms) of `wanted`, against every document of the index.

    Returns (segment, doc, doc_id, n_words, hits, items): a row for each document, `hits` being a flat array of begin
    and end positions of matches in it, `items` the distinct items matched. Without `within` a match is the exact
    phrase; with it, every term within so many words in any order. Phrases go to the tasks in blocks of at most
    block_bytes, so their number isn't bounded by a task's memory.
    """
    spark = index.sparkSession
    wanted = written(wanted, "phrases")
    bytes_ = wanted.agg(F.sum(F.aggregate("terms", F.length("item").cast("long") + 64, lambda a, x: a + F.octet_length(x) + 32))).first()[0] or 0
    n_blocks = int(bytes_ // block_bytes) + 1
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("doc_id", id_type),
        T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def one(block: DataFrame) -> DataFrame:
        # Of checked size: at most block_bytes of phrases, their terms, and the terms' counts over the corpus.
        terms = block.select(F.explode("terms").alias("term")).distinct()
        relevant = index.join(F.broadcast(terms.union(spark.createDataFrame([("",)], "term string"))), "term")
        counts = {r.term: r.n for r in relevant.where("term != ''").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        by_rarest: dict[str, list] = {}
        grouped = block.groupBy("terms").agg(F.collect_set("item").alias("items"))
        for r in grouped.toLocalIterator():
            if all(t in counts for t in r.terms):
                places = sorted({t: (counts[t], t, i) for i, t in reversed(list(enumerate(r.terms)))}.values()) if within else sorted((counts[t], t, i) for i, t in enumerate(r.terms))
                by_rarest.setdefault(places[0][1], []).append(([(t, i) for _, t, i in places], len(r.terms), sorted(r["items"])))
        shared = spark.sparkContext.broadcast(by_rarest)

        def run(table: pa.Table) -> pa.Table:
            rows = zip(table.column("term").to_pylist(), table.column("positions").to_pylist(), strict=True)
            lists = {t: np.cumsum(np.frombuffer(p, dtype=np.int32), dtype=np.int32) for t, p in rows if t}
            k = table.column("term").to_pylist().index("")
            ids, sizes = table.column("ids")[k].as_py(), np.frombuffer(table.column("sizes")[k].as_py(), dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
            hits: list[list[int]] = [[] for _ in ids]
            items: list[set[str]] = [set() for _ in ids]
            for rare in lists.keys() & shared.value.keys():
                for places, length, whose in shared.value[rare]:
                    if any(t not in lists for t, _ in places):
                        continue
                    if within:
                        begin, end = near([lists[t] for t, _ in places], within)
                    else:
                        begin = exact([(i, lists[t]) for t, i in places])
                        end = begin + length
                    docs = np.searchsorted(starts, begin, side="right") - 1
                    for d, a, b in zip(docs.tolist(), begin.tolist(), end.tolist(), strict=True):
                        if b <= starts[d] + sizes[d]:
                            hits[d] += [int(a - starts[d]), int(b - starts[d])]
                            items[d].update(whose)
            n = len(ids)
            return pa.table([
                pa.array([table.column("segment")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ids, table.schema.field("ids").type.value_type),
                pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["segment", "doc", "doc_id", "n_words", "hits", "items"])

        return relevant.select("segment", "term", "positions", "ids", "sizes").groupBy("segment").applyInArrow(run, schema)

    found = one(wanted.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == 0) if n_blocks > 1 else wanted)
    for i in range(1, n_blocks):
        found = found.union(one(wanted.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i)))
    if n_blocks > 1:
        found = found.groupBy("segment", "doc").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return found


@F.pandas_udf(T.LongType())
def covered(hits: pd.Series) -> pd.Series:
    """How many positions the begin-end pairs cover together."""

    def one(flat) -> int:
        total, reach = 0, 0
        for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
            total += max(0, b - max(a, reach))
            reach = max(reach, b)
        return total

    return hits.map(one)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated): a row for each row of docs.

    n_hit counts words inside any occurrence of any window of any item; items are sorted as strings. A document is
    contaminated with a hit, and hits on a twentieth of its words or more. Null, empty and wordless texts have zeros;
    without items nothing is hit; equal items all count.
    """
    bounded_batches(docs.sparkSession)
    wanted = phrases(items, item_col, item_text_col, n)
    found = search(build_index(docs, id_col, text_col), wanted)
    n_hit = covered("hits")
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without its contaminated rows, with all their columns."""
    t1, t2 = content_key(F.col(text_col))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2")).alias("key"), F.col(text_col).alias("text"))
    found = contamination(keyed, items, "key", "text", **options)
    bad = written(found.where("contaminated").select("doc_id.*").distinct(), "contaminated")
    h1, h2 = fresh(docs, "h1", "h2")
    left = docs.withColumns({h1: t1, h2: t2})
    bad = bad.toDF(*fresh(left, "bad_id", "bad_1", "bad_2"))
    i, b1, b2 = bad.columns
    return left.join(bad, left[id_col].eqNullSafe(bad[i]) & (left[h1] == bad[b1]) & (left[h2] == bad[b2]), "left_anti").select(*docs.columns)
