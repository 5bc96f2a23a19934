"""The hit limiter: folds in blocks, busy keys over many tasks, streams."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailwarden.streaming import limits


def plain(times, width, most, opened=None, hits=0):
    out = []
    for t in times:
        if opened is None or t > opened + width:
            opened, hits = t, 1
        else:
            hits += 1
        out.append(hits > most)
    return out, opened, hits


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.integers(1, 40), st.integers(1, 4), st.integers(1, 9))
def test_blocks_compose_to_the_fold(times, width, most, windows):
    times = sorted(times)
    expected = plain(times, width, most)
    assert limits.fold_hits(np.array(times), limits.NEVER, 0, width, most)[0].tolist() == expected[0]
    opened, hits, got = limits.NEVER, 0, []
    size = width * windows
    for block in sorted({t // size for t in times}):
        own = np.array([t for t in times if t // size == block])
        got += limits.fold_hits(own, opened, hits, width, most)[0].tolist()
        opened, hits = limits.through_block(opened, hits, len(own), width, *limits.block_function(own, block * size, width))
    assert (got, opened, hits) == expected


def test_a_step_function_is_small():
    times = np.arange(0, 1_000_000, 7)
    steps, *_ = limits.block_function(times, 0, 10_000)
    assert len(steps) <= 10_000 // 7 + 2


def hits_of(spark, n):
    """Two thirds of the hits from one address, in bursts and pauses; ties in time; some without address or time."""
    at = F.floor(F.col("id") / 3) + F.floor(F.col("id") / 500) * 90
    return spark.range(n).select("id", F.when(F.col("id") % 3 < 2, "10.0.0.1").when(F.col("id") % 7 != 0, F.concat(F.lit("10.1.0."), (F.col("id") % 50).cast("string"))).alias("client_ip"), F.when(F.col("id") % 101 != 0, F.timestamp_seconds(1_700_000_000 + at)).alias("timestamp"), F.lit("x").alias("limited"))


def expected(df, seconds, most):
    by_key: dict = {}
    for r in df.collect():
        by_key.setdefault(r.client_ip, []).append((r.timestamp.timestamp() if r.timestamp else None, str(r.id)))
    out = {}
    for key, own in by_key.items():
        known = sorted(x for x in own if x[0] is not None)
        out.update({(key, i): limited for (_, i), limited in zip(known, plain([t for t, _ in known], seconds, most)[0], strict=True)})
        out.update({(key, i): False for t, i in own if t is None})
    return out


def test_one_address_over_many_tasks(spark):
    df = hits_of(spark, 20_000)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = limits.limit_hits(df, seconds=60, most=5, block_windows=2).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.key, r.id): r.limited for r in got} == expected(df, 60, 5)
    assert len({r.task for r in got if r.key == "10.0.0.1"}) >= 30
    whole = limits.limit_hits(df, seconds=60, most=5)
    assert {(r.key, r.id): r.limited for r in whole.collect()} == expected(df, 60, 5)
    assert limits.limit_hits(df.limit(0)).collect() == []


def test_stream_with_a_busy_address(spark, tmp_path):
    df = hits_of(spark, 6000)
    for k in range(3):  # three batches, each later than the one before
        df.where(f"id >= {k * 2000} AND id < {(k + 1) * 2000}").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")  # so that a key has several frames
    try:
        for name in ("all", "steps"):
            source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1 if name == "steps" else 10).parquet(str(tmp_path / "in/*"))
            query = limits.limit_hits_stream(source, seconds=60, most=5).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
            query.awaitTermination()
            got = {(r.key, r.id): r.limited for r in spark.read.parquet(str(tmp_path / name)).collect()}
            want = {k: v for k, v in expected(df.where("timestamp IS NOT NULL"), 60, 5).items()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
