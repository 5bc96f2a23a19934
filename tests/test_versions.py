"""The versioned table: whole batches, bounded disk, batches that are run again."""

import os

from pyspark.sql import functions as F

from mailwarden.streaming.versions import VersionedTable

SCHEMA = "k string, x long"


def newest(old, new):
    both = old.withColumn("n", F.lit(0)).unionByName(new.withColumn("n", F.lit(1)))
    return both.groupBy("k").agg(F.max_by("x", "n").alias("x"))


def disk(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def rows(df):
    return {r.k: r.x for r in df.collect()}


def test_batches_are_whole_and_disk_is_bounded(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=4, keep=2)
        assert rows(table.current()) == {}
        want: dict = {}
        sizes = []
        for n in range(12):
            new = {f"k{(n * 7 + j) % 30}": n * 100 + j for j in range(3)}
            before = table.current()
            table.update(spark.createDataFrame(list(new.items()), SCHEMA), n, newest)
            assert rows(before) == want  # a reader that began before the batch has the version before
            want.update(new)
            assert rows(table.current()) == want
            sizes.append(disk(tmp_path / "t"))
            assert len(table.published()) <= 2
        whole = tmp_path / "whole"
        table.current().withColumn("bucket", table.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(str(whole))
        assert sizes[-1] <= 2.05 * disk(whole)
        assert max(sizes) <= 2.05 * disk(whole) * 1.2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_batch_that_is_run_again(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=2)
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("x").alias("x"))
    table.update(df(("a", 1), ("b", 2)), 0, add)
    table.update(df(("a", 10)), 1, add)
    table.update(df(("a", 10)), 1, add)  # the same batch once more
    assert rows(table.current()) == {"a": 11, "b": 2}
    df(("a", 77)).withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(str(tmp_path / "t/data/v=2"))  # a batch that died before it published
    assert rows(table.current()) == {"a": 11, "b": 2}
    table.update(df(("b", 5)), 2, add)
    assert rows(table.current()) == {"a": 11, "b": 7}
    table.update(df(), 3, add)
    table.update(df(("c", 1)), 0, add, "another stream")
    table.update(df(("c", 1)), 0, add, "another stream")
    assert rows(table.current()) == {"a": 11, "b": 7, "c": 1}
