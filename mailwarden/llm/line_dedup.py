"""Line dedup: hashes range-partitioned with a secondary sort by document and position; the result is a
compressed keep bitmap for each document, not text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, content_key, fresh, lower_ascii, written

WHITE = " \t\n\x0b\x0c\r"
LONG_PART = 1 << 20
DROP, UNSURE, EDGE = 0, 1, 2


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc, t1, t2, pos, k): a row for each line whose key has min_chars code points or more.

    Range-partitioned and sorted by hash, then document, then position. The range runs over document and position
    too, so one very common line spreads over many partitions. A key is the line stripped of ASCII white space at
    both ends, A-Z in lower case. k is a hash of the document. Null texts have one empty line, so no row here.
    """
    t1, t2 = content_key(F.col(text_col))
    lines = docs.select(
        F.col(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    key = lower_ascii(F.btrim("line", F.lit(WHITE)))
    lines = lines.withColumn("line", key).where(F.length("line") >= max(1, min_chars))
    rows = written(lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "doc", "t1", "t2", "pos", F.xxhash64("doc", "t1", "t2").alias("k")), "lines")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc", "t1", "t2", "pos"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


@dataclass
class Run:
    """The lines of one key that a task has read so far."""

    key: tuple[int, int]
    opens: bool  # it is the task's first key, so it may have begun in the task before
    first: int  # hash of its first document
    last: int = 0
    n_docs: int = 0
    led: bool = False  # its first line has gone out
    waiting: list[pa.RecordBatch] = field(default_factory=list)  # lines of fewer than min_docs documents


def repeated_lines(index: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """(doc, t1, t2, pos): the lines to drop, from one pass over the sorted index.

    Each task streams its range and counts documents key by key; it holds back the lines of a key only until min_docs
    documents have it. A key that reaches over the end of a task is settled from one row each task has about its first
    and its last key: those two rows a task are all that is joined, by broadcast.
    """
    id_field = index.schema["doc"]
    schema = T.StructType([
        *(T.StructField(c, T.IntegerType()) for c in ("kind", "task")), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), id_field, T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()),
        T.StructField("pos", T.IntegerType()), T.StructField("first", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_docs", "first_doc", "last_doc"))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        current: Run | None = None

        def out(rows: pa.RecordBatch, kind: int, leads: bool = False) -> pa.RecordBatch:
            n = rows.num_rows
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.full(n, task, dtype=np.int32)), *(rows.column(c) for c in ("h1", "h2", "doc", "t1", "t2", "pos")),
                pa.array(np.arange(n) == (0 if leads else -1)), none, none, none], names=schema.names)

        def extend(run: Run, rows: pa.RecordBatch, k: np.ndarray) -> Iterator[pa.RecordBatch]:
            begins = run.n_docs == 0
            run.n_docs += int((k[1:] != k[:-1]).sum()) + int(begins or k[0] != run.last)
            run.last = int(k[-1])
            if run.opens:
                yield out(rows, UNSURE, begins)
                return
            run.waiting.append(rows)
            if run.n_docs >= min_docs:
                for part in run.waiting:
                    yield out(part.slice(1) if keep_first and not run.led else part, DROP)
                    run.led = True
                run.waiting = []

        def close(run: Run, ends: bool) -> Iterator[pa.RecordBatch]:
            if run.opens or ends:
                one = [pa.array([x], f) for x, f in zip((EDGE, task, *run.key), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                facts = [pa.array([x], pa.int64()) for x in (run.n_docs, run.first, run.last)]
                nothing = [pa.nulls(1, kind) for kind in (doc_type, pa.int64(), pa.int64(), pa.int32(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*one, *nothing, *facts], names=schema.names)
            if ends and run.n_docs < min_docs:
                for i, part in enumerate(run.waiting):
                    yield out(part, UNSURE, i == 0)

        doc_type, before = None, None
        for batch in batches:
            doc_type = batch.column("doc").type
            line = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2", "k", "pos")])
            again = np.concatenate([np.array([before is not None and (line[:, 0] == before).all()] * min(1, batch.num_rows), dtype=bool), (line[:, 1:] == line[:, :-1]).all(axis=0)])
            if again.any():  # repeated rows of docs: one document
                line, batch = line[:, ~again], batch.filter(pa.array(~again))
            if not batch.num_rows:
                continue
            h1, h2, k, _ = line
            before = line[:, -1]
            new_key = np.concatenate([[current is None or current.key != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            starts = np.flatnonzero(new_key)
            head = int(starts[0]) if len(starts) else batch.num_rows
            if head:
                yield from extend(current, batch.slice(0, head), k[:head])
            if not len(starts):
                continue
            last = int(starts[-1])
            opens = current is None
            if current is not None:
                yield from close(current, False)
            if opens and head < last:  # the task's first key ends within its first batch
                stop = int(starts[1])
                run = Run((int(h1[0]), int(h2[0])), True, int(k[0]))
                yield from extend(run, batch.slice(0, stop), k[:stop])
                yield from close(run, False)
                starts, head, opens = starts[1:], stop, False
            if head < last:  # keys that begin and end within this batch
                new_doc = new_key | np.concatenate([[True], k[1:] != k[:-1]])
                docs = np.add.reduceat(new_doc[head:last].astype(np.int64), starts[:-1] - head)
                sizes = np.diff(starts)
                drop = np.repeat(docs >= min_docs, sizes)
                if keep_first:
                    drop[starts[:-1] - head] = False
                if drop.any():
                    yield out(batch.slice(head, last - head).filter(pa.array(drop)), DROP)
            current = Run((int(h1[last]), int(h2[last])), opens, int(k[last]))
            yield from extend(current, batch.slice(last), k[last:])
        if current is not None:
            yield from close(current, True)

    found = written(index.mapInArrow(stream, schema), "repeated-lines")
    by_task = W.partitionBy("h1", "h2").orderBy("task")
    edges = found.where(F.col("kind") == EDGE).withColumn("shared", (F.lag("last_doc").over(by_task) == F.col("first_doc")).cast("long"))
    common = edges.groupBy("h1", "h2").agg((F.sum("n_docs") - F.coalesce(F.sum("shared"), F.lit(0))).alias("n"), F.min("task").alias("begins")).where(F.col("n") >= min_docs)
    unsure = found.where(F.col("kind") == UNSURE).join(F.broadcast(common.select("h1", "h2", "begins")), ["h1", "h2"])
    if keep_first:
        unsure = unsure.where(~(F.col("first") & (F.col("task") == F.col("begins"))))
    columns = ["doc", "t1", "t2", "pos"]
    return found.where(F.col("kind") == DROP).select(*columns).union(unsure.select(*columns))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, t1, t2, n_dropped, bitmap) for each distinct document that loses lines.

    Keys found in at least min_docs documents lose all their lines, or all but the very first in order of document
    and position with keep_first. A document is a distinct pair of id and text: repeated rows are one document and
    share one bitmap. The bitmap is zlib over packed bits, the last dropped line's bit included; lines beyond its end
    are kept. Documents that lose nothing have no row; an empty table gives none.
    """
    gone = repeated_lines(line_index(docs, id_col, text_col, min_chars), min_docs, keep_first)

    # Bits are set by parts of LONG_PART lines, so no row holds more positions than that.
    @F.pandas_udf("binary")
    def packed(drops: pd.Series) -> pd.Series:
        def one(at) -> bytes:
            bits = np.ones(int(max(at)) // 8 * 8 + 8, dtype=np.uint8)  # whole bytes: packbits fills up with zeros
            bits[np.asarray(at, dtype=np.int64)] = 0
            return zlib.compress(np.packbits(bits).tobytes())

        return drops.map(one)

    parts = gone.groupBy("doc", "t1", "t2", F.expr(f"pos div {LONG_PART}").alias("part")).agg(
        F.collect_set(F.col("pos") % LONG_PART).alias("drops"))
    parts = parts.select("doc", "t1", "t2", F.size("drops").cast("long").alias("n"), F.struct("part", packed("drops").alias("bits")).alias("one"))
    return parts.groupBy("doc", "t1", "t2").agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list("one")).alias("bitmap"))


def kept_positions(bitmap, n: int) -> np.ndarray:
    """Which of a document's n lines stay."""
    keep = np.ones(n, dtype=bool)
    for part in bitmap if bitmap is not None else []:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(part["bits"]), dtype=np.uint8)).astype(bool)
        at = int(part["part"]) * LONG_PART
        bits = bits[: max(0, n - at)]
        keep[at : at + len(bits)] &= bits
    return keep


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """docs with its text column rewritten without the common lines, plus n_lines and n_dropped.

    All other columns stay. Null texts stay null where they lose nothing (n_lines 1, n_dropped 0). The two counts take
    names with underscores before them where docs has such columns already.
    """
    bounded_batches(docs.sparkSession)
    maps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first)
    k1, k2, kid, n_lines, n_dropped, bitmap = fresh(docs, "k1", "k2", "kid", "n_lines", "n_dropped", "bitmap")
    t1, t2 = content_key(F.col(text_col))
    maps = maps.toDF(kid, k1, k2, n_dropped, bitmap)
    d1, d2 = fresh(maps, *fresh(docs, "d1", "d2"))
    left = docs.withColumns({d1: t1, d2: t2})
    joined = left.join(maps, (left[id_col].eqNullSafe(maps[kid])) & (left[d1] == maps[k1]) & (left[d2] == maps[k2]), "left")
    out = joined.select(*docs.columns, n_dropped, bitmap)

    @F.pandas_udf("text string, n long")
    def rewrite(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, maps in it:
            kept, n = [], []
            for t, m in zip(text, maps, strict=True):
                lines = (t or "").split("\n")
                n.append(len(lines))
                if m is None or len(m) == 0:
                    kept.append(t)
                else:
                    keep = kept_positions(m, len(lines))
                    kept.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
            yield pd.DataFrame({"text": kept, "n": n})

    done = out.withColumn(bitmap, rewrite(F.col(text_col), F.col(bitmap)))
    cols = [F.col(bitmap)["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return done.select(*cols, F.col(bitmap)["n"].alias(n_lines), F.coalesce(n_dropped, F.lit(0)).cast("long").alias(n_dropped))
