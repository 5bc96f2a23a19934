"""Models, calibration, thresholds, groups, sources and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mailwarden.operators import analytics, batch, features, scoring, synthetic, training
from mailwarden.sources import io
from mailwarden.sources.fixtures import signups, validations
from mailwarden.streaming import jobs

SF = "/root/testdata/sf0.001"
LEAF = lambda v: {"t": "l", "v": v}
FOREST = {"meta": {"features": ["a", "b"], "tree_count": 2, "config": {"max_depth": 3}}, "forest": [{"t": "n", "f": "a", "v": 0.5, "l": LEAF(0.2), "r": LEAF(0.8)}, {"t": "n", "f": "b", "v": 1.0, "l": LEAF(0.1), "r": {"t": "n", "f": "a", "v": 0.9, "l": LEAF(0.4), "r": LEAF(1.0)}}]}


def test_forest_walks(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.6, 2.0), (1.0, 2.0), (None, float("nan")), (float("nan"), 5.0)], "a double, b double")
    assert [round(r.score, 6) for r in scoring.forest_score(df, FOREST).collect()] == [0.15, 0.6, 0.9, 0.15, 0.3]
    assert scoring.forest_score(df.select("a"), FOREST).first().score == pytest.approx(0.15)
    shallow = {**FOREST, "meta": {**FOREST["meta"], "config": {"max_depth": 1}}}
    assert scoring.forest_score(df.where("a = 1"), shallow).first().score == pytest.approx(0.4)
    cal = {**FOREST, "meta": {**FOREST["meta"], "calibration": {"coef": 2.0, "intercept": -1.0}}}
    assert 0 < scoring.forest_score(df, cal).first().score < 1
    assert scoring.validate_model(FOREST) == [] and scoring.validate_model({"meta": {}, "forest": []})
    assert features.feature_alignment(["a"], ["a", "b"]) == {"missing": ["b"], "extra": [], "missing_ratio": 0.5, "ok": False}


def test_tree_in_both_forms(spark):
    df = spark.createDataFrame([(0.1,), (0.9,), (None,)], "x double")
    long_form = {"type": "node", "feature": "x", "threshold": 0.5, "left": {"type": "leaf", "value": 0.1, "reason": "low"}, "right": {"type": "leaf", "value": 0.9, "reason": "high"}}
    short = {"t": "n", "f": "x", "v": 0.5, "l": {"t": "l", "v": 0.1, "reason": "low"}, "r": {"t": "l", "v": 0.9, "reason": "high"}}
    for tree in (long_form, short, {"forest": [short]}):
        assert [r.v.reason for r in df.select(scoring.decision_tree_score(tree).alias("v")).collect()] == ["low", "high", "high"]


def test_lifts_and_decisions(spark):
    zero = {k: F.lit(0.0) for k in scoring.RULES}
    got = spark.range(1).select(
        scoring.heuristic_lifts(F.lit(0.2), {**zero, "tld_risk_score": F.lit(0.85), "plus_risk": F.lit(0.9)}).alias("a"), scoring.heuristic_lifts(F.lit(0.99), {**zero, "tld_risk_score": F.lit(1.0)}).alias("b"),
        scoring.decide(F.lit(0.88)).alias("c"), scoring.decide(F.lit(0.5), scoring.Config(override="block")).alias("d")).first()
    assert got.a.score == pytest.approx(0.91) and list(got.a.reasons) == ["heuristic_tld_high", "heuristic_plus_tag_abuse"]
    assert got.b.score == 0.99 and got.c == "warn" and got.d == "block"
    e = scoring.Experiment("e", 50, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))
    assert e.problems() == [] and scoring.variant_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    out = spark.range(200).select(scoring.assign_variant(F.sha2(F.col("id").cast("string"), 256), e, dt.datetime(2024, 1, 5)).alias("v")).groupBy("v.variant").count().collect()
    assert all(70 < r["count"] < 130 for r in out)


def test_scoring_in_batch_and_stream_agree(spark, tmp_path):
    rows = signups(spark, SF).drop("risk_score", "latency").limit(60)
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.start_scoring(jobs.score_stream(source, 2025, FOREST), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    one = scoring.score_signups(spark.read.parquet(str(tmp_path / "in")), 2025, FOREST)
    assert sorted((r.id, round(r.risk_score, 6), r.decision) for r in io.read_validations(spark, str(tmp_path / "out")).collect()) == sorted((r.id, round(r.risk_score, 6), r.decision) for r in one.collect())
    samples = jobs.samples_of(one)
    data = io.build_training_dataset(samples)
    assert set(features.FEATURE_NAMES) <= set(data.columns) and data.count() == 60
    q = jobs.start_samples(jobs.score_stream(source, 2025, FOREST), str(tmp_path / "samples"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert jobs.current_samples(spark, str(tmp_path / "samples")).count() == samples.select("email_hash").distinct().count()
    assert jobs.alert_stream(one).columns[0] == "email"


def _run(stream, mode, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_counts_limits_and_repeats(spark, tmp_path):
    log = validations(spark, SF)
    log.write.parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    hourly = _run(jobs.hourly_decisions(stream()), "complete", "hourly", spark)
    want = analytics.timeline(log, 8760)
    assert sorted((str(r.hour), r.decision, r["count"]) for r in hourly.collect()) == sorted((str(r.hour), r.decision, r["count"]) for r in want.collect())
    busy = _run(jobs.busy_fingerprints(stream(), 1, length="6 hours", slide="1 hour"), "complete", "busy", spark)
    assert busy.count() > 0
    hit = _run(jobs.limit_hits_stream(stream(), seconds=86_400, most=2), "append", "hits", spark)
    one = jobs.limit_hits(log, seconds=86_400, most=2)
    assert sorted((r.id, r.limited) for r in hit.collect()) == sorted((r.id, r.limited) for r in one.collect())
    assert 0 < one.where("limited").count() < log.count()
    twice = signups(spark, SF).select("email", "timestamp").limit(20)
    twice.union(twice).coalesce(1).write.parquet(str(tmp_path / "twice"))
    out = _run(jobs.distinct_signups(spark.readStream.schema(twice.schema).parquet(str(tmp_path / "twice")), within="1000 days"), "append", "once", spark)
    assert out.count() == twice.select("email").distinct().count()


def test_platt_and_thresholds(spark):
    df = spark.createDataFrame([(i / 100, int(i > 50) if i % 7 else int(i <= 50)) for i in range(100)], "score double, label int")
    c = training.fit_platt(df)
    assert c["coef"] > 0 and c["samples"] == 100
    with pytest.raises(ValueError):
        training.fit_platt(df.limit(5))
    with pytest.raises(ValueError):
        training.fit_platt(df.where("label = 1"))
    scan = training.threshold_scan(df).orderBy("threshold").collect()
    assert len(scan) == 91 and all(r.tp + r.fn == r.support_positive for r in scan)
    assert all(x.recall >= y.recall for x, y in zip(scan, scan[1:], strict=False))
    assert training.recommend_thresholds(training.threshold_scan(df)).count() == 0
    assert len(training.thresholds(step=0.05)) == 19


def test_training_is_seeded_and_learns(spark):
    df = spark.range(400).select("id", (F.col("id") % 100 / 100.0).alias("a"), F.rand(3).alias("b"), (F.col("id") % 100 > 60).cast("int").alias("label")).cache()
    kw = {"trees": 3, "min_leaf": 5, "max_depth": 3}
    one, two = (training.train_forest(df, ["a", "b"], **kw) for _ in range(2))
    assert json.dumps(one) == json.dumps(two) and scoring.validate_model(one) == []
    assert training.auc(scoring.forest_score(df, one)) > 0.98
    oof = training.out_of_fold_scores(df, ["a", "b"], "id", folds=2, **kw)
    assert oof.count() == 400 and oof.agg(F.avg("correct")).first()[0] > 0.9
    tree = training.train_tree(df, ["a", "b"], min_leaf=5)
    assert df.select(scoring.decision_tree_score(tree).alias("v")).first().v.reason
    best = training.random_search(df, ["a", "b"], draws=1, folds=2)
    assert best[0]["auc"] > 0.9


def test_samples(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    schema = "email_hash string, feature_vector string, label int, label_source string, timestamp timestamp"
    old = spark.createDataFrame([("a", '{"x":1}', 1, "manual", t0), ("b", '{"x":2}', 0, "model", t0)], schema)
    new = spark.createDataFrame([("a", '{"x":3,"y":4}', 0, "model", t1)], schema)
    assert {(r.email_hash, r.label) for r in training.upsert_samples(old, new).collect()} == {("a", 0), ("b", 0)}
    assert {(r.email_hash, r.label) for r in training.upsert_samples(old, new, True).collect()} == {("a", 1), ("b", 0)}
    fixed = training.correct_labels(old, spark.createDataFrame([("b", 1), ("z", 1)], "email_hash string, label int"), t1)
    assert {(r.email_hash, r.label, r.label_source, r.feature_vector) for r in fixed.collect()} == {("a", 1, "manual", '{"x":1}'), ("b", 1, "manual", '{"x":2}'), ("z", 1, "manual", "{}")}
    data = io.build_training_dataset(training.upsert_samples(old, new, False).union(fixed.where("email_hash = 'z'")))
    assert data.columns == ["x", "y", "label", "weight"] and {(r.x, r.y, r.weight) for r in data.collect()} == {(3.0, 4.0, 1.0), (2.0, 0.0, 1.0)}
    assert io.build_training_dataset(old.limit(0)).columns == ["label", "weight"]
    assert training.prune(old, 1, dt.datetime(2024, 1, 3)).count() == 0


def test_groups(spark):
    df = spark.createDataFrame([(e,) for e in ("user001@g.com", "user002@g.com", "user003@g.com", "a.b+1@gmail.com", "ab+2@gmail.com", "a.b+9@gmail.com", None)], "email string")
    top = batch.plus_alias_groups(df).first()
    assert (top.canonical, top["count"], top.has_abuse, list(top.variants)) == ("ab@gmail.com", 3, True, ["a.b+1@gmail.com", "a.b+9@gmail.com", "ab+2@gmail.com"])
    assert {r.canonical: r.pattern for r in batch.plus_tag_pattern(df).collect()} == {"ab@gmail.com": "none"}
    assert batch.plus_tag_pattern(df.where("email != 'a.b+9@gmail.com'")).first().pattern == "sequential"
    seq = batch.sequential_batch(df, 2025).first()
    assert (seq.family, seq["count"]) == ("user[NUM]@g.com", 3) and seq.confidence == pytest.approx(0.95)
    assert batch.sequential_batch(df.limit(0), 2025).count() == 0
    fam = batch.pattern_families(df, 2025).first()
    assert fam["count"] == 3 and fam.is_top and fam.suspicious


def test_benford(spark):
    natural = [f"user{d}{i}@x.com" for d, k in zip(range(1, 10), (30, 18, 12, 10, 8, 7, 6, 5, 4), strict=True) for i in range(k)]
    df = spark.createDataFrame([(e, "n") for e in natural] + [(f"u9{i}@x.com", "s") for i in range(60)] + [("a1@x.com", "few")], "email string, g string")
    got = {r.g: r for r in batch.benford(df, by=["g"]).collect()}
    assert got["n"].follows and not got["s"].follows and got["s"].automated and got["s"].suspicious
    assert got["few"].sample_size == 1 and got["few"].p_value == 1.0 and not got["few"].follows


def test_typosquats_and_synthetic(spark):
    v = spark.createDataFrame([("gmail.com",)], "domain string").select(synthetic.typosquat_variants(F.col("domain")).alias("v")).first().v
    assert {"gnail.com", "gmial.com", "ggmail.com", "gmil.com", "gmail.co", "gmai1.com"} <= set(v)
    df = synthetic.synthetic_dataset(spark, 3000, 0.5).cache()
    assert df.where("email NOT LIKE '%@%'").count() == 0
    legit = df.where("label = 'legitimate'").count()
    assert 1350 < legit < 1650 and 1050 < df.where("name = ''").count() < 1350
    near = synthetic.lookalikes(spark.createDataFrame([("gmai1.com",), ("gmail.com",), ("other.org",)], "d string"), "d", spark.createDataFrame([("gmail.com",)], "domain string"))
    assert [(r.d, r.imitates) for r in near.collect()] == [("gmai1.com", "gmail.com")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,Email,category\nfraud,x@y.z,c1\nlegit,nope,c2\n")
    (tmp_path / "b.csv").write_text("x@y.z,fraud\n")
    (tmp_path / "c.json").write_text(json.dumps({"count": 1, "emails": [{"email": "a@b.c", "type": "legit", "category": "k"}]}))
    (tmp_path / "d.txt").write_text("# list\n\nTemp.com\ntemp.com \nother.org\n")
    assert [tuple(r) for r in io.read_labeled(spark, str(tmp_path / "a.csv")).collect()] == [("x@y.z", "fraud", "c1")]
    assert [tuple(r) for r in io.read_labeled(spark, str(tmp_path / "b.csv")).collect()] == [("x@y.z", "fraud", None)]
    assert [tuple(r) for r in io.read_labeled_json(spark, str(tmp_path / "c.json")).collect()] == [("a@b.c", "legit", "k")]
    assert {r.domain for r in io.read_domain_list(spark, [str(tmp_path / "d.txt")]).collect()} == {"temp.com", "other.org"}
    log = validations(spark, SF).limit(50)
    io.append_validations(log, str(tmp_path / "log"))
    io.append_validations(log, str(tmp_path / "log"))
    assert io.read_validations(spark, str(tmp_path / "log")).count() == 100
    io.export(log.select("id", "decision"), str(tmp_path / "e"), "csv")
    assert spark.read.csv(str(tmp_path / "e"), header=True).count() == 50
    io.write_features(spark.createDataFrame([(1.0, 2.0, 1, "x")], "b double, a double, label int, email string"), str(tmp_path / "f"), ["b", "a"], include_email=True)
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["a", "b", "email", "label"]
    with pytest.raises(ValueError):
        analytics.recent(log, 0)


def test_partitions_dont_matter(spark):
    rows = signups(spark, SF)
    one, many = (sorted(map(str, features.export_features(rows.limit(1000).coalesce(1).repartition(k), 2025, keep=["id"], skip_mx=True).select("id", "ngram_risk_score", "bigram_entropy", "tld_risk_score").collect())) for k in (1, 8))
    assert one == many


def test_exact_percentiles_stay_within_ranges_of_values(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from mailwarden.operators.ranks import running_counts

    values = [float(v) for v in np.random.default_rng(5).gamma(2, 30, 3000).round(1)] + [7.0] * 1500 + [None] * 10
    df = spark.createDataFrame([(v, "block", 0.5) for v in values], "latency double, decision string, risk_score double")
    known = sorted(v for v in values if v is not None)
    got = {r.v: (r.upto, r.total) for r in running_counts(df, "latency", parts=50).collect()}
    assert got == {v: (int(np.searchsorted(known, v, side="right")), len(known)) for v in set(known)}
    r = training.detection_rate(df).first()
    assert [r.p50, r.p95, r.p99] == pytest.approx(np.percentile(known, [50, 95, 99]).tolist())
    r = training.floor_percentiles(df).first()
    assert [r.p50, r.p95, r.p99] == [known[int(p * len(known))] for p in (0.5, 0.95, 0.99)]
    empty = df.where(F.lit(False))
    assert training.floor_percentiles(empty).first().p50 is None and training.detection_rate(empty).first().p95 is None
    same = df.where("latency = 7.0")
    assert training.floor_percentiles(same).first().p99 == 7.0


def test_log_queries_read_the_days_they_need(spark, tmp_path):
    from mailwarden.operators import analytics

    log = validations(spark, SF)
    io.append_validations(log, str(tmp_path / "log"))
    stored = io.read_validations(spark, str(tmp_path / "log"))
    rows = analytics.recent(stored, 48)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and ">= " in plan.split("PartitionFilters")[1].split("]")[0]
    assert 0 < rows.count() == analytics.recent(log, 48).count() < log.count()
    assert sorted(map(tuple, analytics.timeline(stored, 48).collect())) == sorted(map(tuple, analytics.timeline(log, 48).collect()))


def test_samples_of_several_batches(spark, tmp_path):
    rows = spark.range(60).selectExpr("concat('h', id % 25) AS email_hash", "struct(id AS x) AS feature_vector", "id % 7 = 0 AS is_disposable", "false AS is_free_provider", "id % 10 / 10D AS risk_score",
                                      "CASE WHEN id % 3 = 0 THEN 'block' ELSE 'allow' END AS decision", "timestamp_seconds(1700000000 + id * 60) AS timestamp", "id")
    for k in range(3):
        rows.where(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second time all three batches are run again, over what the first has left
        jobs.start_samples(source, str(tmp_path / "samples"), str(tmp_path / f"cp{_}"), buckets=4).awaitTermination()
        got = jobs.current_samples(spark, str(tmp_path / "samples")).select("email_hash", "timestamp", "risk_score").collect()
        newest = {r.email_hash: r for r in sorted(rows.collect(), key=lambda r: r.timestamp)}
        assert {r.email_hash: (r.timestamp, r.risk_score) for r in got} == {k: (r.timestamp, r.risk_score) for k, r in newest.items()}
        assert len(got) == 25


def test_plus_tags_of_an_address(spark):
    rows = [("a+1@x.com",), ("a+2@x.com",), ("a+02@x.com",), ("b+1@x.com",), ("b+9@x.com",), ("c+jan@x.com",), ("c+b@x.com",), ("d+k@x.com",), ("d+K@x.com",), ("d+k@x.com",), (None,)]
    got = {r.canonical: (r.n_tags, r.pattern) for r in batch.plus_tag_pattern(spark.createDataFrame(rows, "email string")).collect()}
    assert got == {"a@x.com": (3, "sequential"), "b@x.com": (2, "none"), "c@x.com": (2, "dated"), "d@x.com": (3, "keyword")}


def test_cuts_of_a_split_are_searched_for_once(spark, monkeypatch):
    df = spark.range(600).select("id", (F.col("id") % 100 / 100.0).alias("a"), F.rand(5).alias("b"), (F.col("id") % 100 > 60).cast("int").alias("label")).cache()
    searches = []
    monkeypatch.setattr(training, "kth_least", lambda *frames, search=training.kth_least: searches.append(1) or search(*frames))
    monkeypatch.setattr(training, "guardrails", lambda *_: {"passed": False})
    monkeypatch.setattr(training, "train_forest", lambda fit, *args, train=training.train_forest, **kw: plans.append(fit) or train(fit, *args, **kw))
    plans: list = []
    got = training.train_until_passed(df, ["a", "b"], trees=2, max_depth=2)
    assert got["attempts"] == 3 and len(plans) == 3 and len(searches) == 1
    assert not any("Window" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    monkeypatch.undo()
    kept, lazy = training.stratified_split(df, key="id", write_cuts=True), training.stratified_split(df, key="id")
    assert all(x.columns == y.columns and sorted(x.collect()) == sorted(y.collect()) for x, y in zip(kept, lazy, strict=True))
    assert kept[0].groupBy("label").count().orderBy("label").collect() == [(0, 293), (1, 187)]


def test_forest_query_does_not_search_for_cuts_in_each_reader(spark, monkeypatch):
    from mailwarden.plans import signup_queries

    rows = lambda df: df.select("id", "label", *[(F.col("id") * (i + 3) % 97 / 97.0).alias(n) for i, n in enumerate(features.FEATURE_NAMES)])
    monkeypatch.setattr(signup_queries, "_train_rows", rows)
    got = signup_queries.QUERIES["t7_forest"](spark, "/root/testdata/sf0.001")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["id", "label", "score"] and got.count() == 200 and got.where("score BETWEEN 0 AND 1").count() == 200


def test_features_of_rows_that_agree_are_worked_out_once(spark, monkeypatch):
    from mailwarden.plans import signup_queries

    mails = ["anna.smith1990@gmail.com", "x9q8@mail.com", "", None, "Jo.Hn+3@Proton.me"]
    rows = [(i, mails[i % 5], [None, "Anna Smith"][i % 2], ["US", None, "DE"][i % 3], "de-DE", i % 2 if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, email string, name string, ip_country string, accept_language string, label int").repartition(3)
    once, plain = features.export_features_once(df, 2025, ["id", "label"], skip_mx=True), features.export_features(df, 2025, keep=["id", "label"], skip_mx=True)
    assert once.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(repr, once.collect())) == sorted(map(repr, plain.collect())) and once.count() == 180
    monkeypatch.setattr(signup_queries.io, "written", lambda made, *_: made)
    assert "collect_list" in signup_queries._train_rows(df)._jdf.queryExecution().optimizedPlan().toString()
