"""Files of different columns, counted writes, sketches."""

from pyspark.sql import functions as F

from mailwarden.operators import analytics
from mailwarden.sources import io


def test_files_with_columns_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,Email,category\nfraud,x@y.z,"c ""1"", d"\nlegit,nope,c2\n')
    (tmp_path / "b.csv").write_text("\nEMAIL_ADDRESS,other,classification\nb@y.z,1,legit\nb2@y.z,2\n\"broken@y.z,3,fraud\nmany@y.z,1,2,3\n")
    (tmp_path / "c.csv").write_text("c@y.z,fraud\n")
    (tmp_path / "d.csv").write_text("")
    got = {tuple(r) for r in io.read_labeled(spark, str(tmp_path)).collect()}
    assert got == {("x@y.z", "fraud", 'c "1", d'), ("b@y.z", "legit", None), ("b2@y.z", None, None), ("c@y.z", "fraud", None)}
    kept = io.read_labeled(spark, [str(tmp_path / "b.csv")], keep_corrupt=True)
    assert {r.corrupt for r in kept.collect()} == {None, '"broken@y.z,3,fraud', "many@y.z,1,2,3"} and kept.count() == 4


def test_fields_of_a_line(spark):
    lines = {"a,b": ["a", "b"], "": [""], ",": ["", ""], '"a,""b""",c': ['a,"b"', "c"], '"a': None, 'a"b,c': None, '"a"b,c': None}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.f for r in df.select("line", io.csv_fields(F.col("line")).alias("f")).collect()} == lines


def test_writes_are_counted(spark, tmp_path):
    rows = [(i, f"u{i % 7}@x.org" if i % 5 else "nothing", "Fraud" if i % 2 else "ham") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, email string, label string").repartition(4)
    counts = io.write_clean(df, str(tmp_path / "clean"))
    kept = spark.read.parquet(str(tmp_path / "clean/status=kept"))
    assert counts == {"kept": 7, "duplicates": 73, "invalid": 20} and kept.count() == 7
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 100
    assert {r.id for r in kept.collect()} == {min(i for i, e, _ in rows if e == f"u{k}@x.org") for k in range(7)}
    assert io.write_clean(df.limit(0), str(tmp_path / "none")) == {"kept": 0, "duplicates": 0, "invalid": 0}
    features = spark.createDataFrame([(1.0, None, 1), (2.0, 3.0, 0)], "a double, b double, label int")
    assert io.write_features(features, str(tmp_path / "f"), ["b", "a"], fmt="csv") == {"rows": 2, "positive": 1, "with_nulls": 1}
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns == ["a", "b", "label"]


def test_sketches_stand_for_the_log(spark):
    log = spark.range(20_000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("timestamp"), F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 20_011).cast("double")).alias("latency"))
    sketches = analytics.latency_sketches(log).cache()
    assert sketches.count() == 28
    known = sorted(r.latency for r in log.where("latency IS NOT NULL").collect())
    got = analytics.sketched_percentiles(sketches).first()
    assert got.rows == len(known)
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(sum(v <= got[name] for v in known) / len(known) - p) <= 0.02
    since = sketches.agg(F.max("hour")).first()[0]
    assert 0 < analytics.sketched_percentiles(sketches, since).first().rows < len(known)
    nothing = analytics.sketched_percentiles(sketches.limit(0)).first()
    assert nothing.rows == 0 and nothing.p50 is None
