"""Helpers shared by the corpus operators: shared scratch tables, fresh column names, byte-bounded blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the op1/op2 contracts, as a Java regular expression.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(col, UPPER_LETTERS, LOWER_LETTERS)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under the folder all executors share, spark.checkpoint.dir; without that setting there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that what follows doesn't recompute it.

    Row ids made before this point are fixed from here on, whatever executors are lost later.
    """
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches of texts have no more than so many rows, for this session.

    Spark bounds a batch's bytes too, at 64 MB; two workers and the JVM that hold such batches at once take too much of a small executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def join_apart(rows: DataFrame, side: DataFrame, keys: list[str], count: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined (inner or left) with side, which has one row for each key, and in `count` how many of the rows have it.

    Keys with more than one in `share` of all rows are joined by broadcast: there are fewer than `share` of them,
    whatever the tables' sizes. So no key with many rows meets in one task. Both tables are read twice.
    """
    facts = side.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    total, most = int(facts.total or 0), int(facts.most or 0)
    if most * share <= total:
        return rows.join(side, keys, how)
    hot = side.where(F.col(count) * share > total)
    apart = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(count) * share <= total), keys, how)
    return apart.unionByName(rest)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def content_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text (null counts as empty): 128 bits that equal texts share."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(20241), text)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the column's bytes in each piece stay near `most` (a larger row stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
