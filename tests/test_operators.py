import numpy as np
import pytest
from pyspark.sql import functions as F

from requestlab.operators import detectors as D
from requestlab.operators import features, joins, metrics, normalize, sampling
from requestlab.plans import q_models, tables
from requestlab.plans.registry import Registry
from requestlab.sources import requests as R
from requestlab.streaming import streams


def judged(spark, pairs):
    return spark.createDataFrame([(i, label, p) for i, (p, label) in enumerate(pairs)], "request_id long, label string, prediction boolean")


def test_metrics_golden(spark):
    t, f, a, v = True, False, "attack", "valid"
    m = metrics.classification_metrics(metrics.confusion_matrix(judged(spark, [(t, a), (f, a), (t, v), (f, v), (t, a), (f, v)]))).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (2, 1, 2, 1)
    assert m["precision"] == m["recall"] == pytest.approx(2 / 3) == m["f1"]
    assert (m["accuracy"], m["fpr"], m["specificity"]) == (pytest.approx(4 / 6), pytest.approx(1 / 3), pytest.approx(2 / 3))


def test_metrics_imbalance_and_empty(spark):
    rows = [(i < 4, "valid") for i in range(99)] + [(True, "attack")]
    m = metrics.classification_metrics(metrics.confusion_matrix(judged(spark, rows))).first()
    assert (m["precision"], m["recall"], m["fpr"]) == (pytest.approx(0.2), 1.0, pytest.approx(4 / 99))
    with pytest.raises(Exception, match="no rows"):
        metrics.confusion_matrix(judged(spark, rows).where("false")).first()


def test_percentile_is_linear(spark):
    s = spark.createDataFrame([(float(x), "valid") for x in (1, 2, 7, 10)], "score double, label string")
    assert metrics.threshold_at_fpr(s, 0.05).first()["threshold"] == pytest.approx(9.55)


def test_labels(spark):
    df = spark.createDataFrame([("bad",)], "l string")
    with pytest.raises(Exception, match="unknown label"):
        df.select(metrics.normalize_label(F.col("l"))).collect()


def cloud(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, "valid", rng.normal(0, 1, 10).tolist()) for i in range(200)] + [(200 + i, "attack", rng.normal(5, 1, 10).tolist()) for i in range(20)]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")


@pytest.mark.parametrize(
    "model",
    [
        D.Mahalanobis(),
        D.RidgeMahalanobis(),
        D.Hypersphere(),
        D.GaussianMixture(k=2, covariance="full", n_init=1, max_iter=5),
        D.IsolationForest(n_estimators=20),
        D.OneClassSVM(n_features=64, max_iter=5),
        D.LocalOutlierFactor(10),
        D.PcaDetector(D.Mahalanobis(), 4),
    ],
    ids=lambda m: type(m).__name__,
)
def test_detectors_rank_attacks_higher(spark, model):
    df = cloud(spark)
    normal = df.where("label = 'valid'")
    with pytest.raises(D.NotFitted):
        model.score(df)
    model.fit(normal)
    means = {r["label"]: r["m"] for r in model.score(df).groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means["attack"] > means["valid"]
    _, fpr = model.set_threshold(normal, 0.05)
    assert fpr <= 0.05 + 1e-9


def test_save_load(spark, tmp_path):
    df = cloud(spark)
    for model in (D.Mahalanobis().fit(df), D.IsolationForest(n_estimators=5).fit(df)):
        path = f"file://{tmp_path}/{model.name}"
        model.save(spark, path)
        a = model.score(df).orderBy("vec_id").select("score").toPandas()["score"]
        b = D.load(spark, path).score(df).orderBy("vec_id").select("score").toPandas()["score"]
        assert np.allclose(a, b)


def test_covariance_golden(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([4.0, 4.0],)], "embedding array<double>")
    _, mean, cov = features.mean_and_covariance(df)
    assert mean == pytest.approx([8 / 3, 11 / 3])
    assert cov[0][0] == pytest.approx(7 / 3) and cov[0][1] == pytest.approx(11 / 6)


def test_neighbors_and_pareto(spark):
    df = cloud(spark)
    got = joins.nearest_neighbors(df, df, 2, block=32, skip_self=True).toPandas()
    x = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    for i in (0, 57, 219):
        want = sorted((float(np.linalg.norm(x[i] - y)), j) for j, y in x.items() if j != i)[:2]
        assert got[got["id"] == i].sort_values("rank")["neighbor"].tolist() == [j for _, j in want]
    runs = spark.createDataFrame([("a", 0.9, 0.04), ("b", 0.8, 0.01), ("c", 0.7, 0.02), ("d", 0.99, 0.5)], "run_id string, recall double, fpr double")
    assert [r["run_id"] for r in joins.pareto_frontier(runs, 0.05).collect()] == ["a", "b"]
    assert sampling.best_run(runs, 0.05).first()["run_id"] == "a"


def test_missing_prediction_is_an_error(spark):
    a, b = judged(spark, [(True, "valid"), (False, "attack")]), judged(spark, [(True, "valid")])
    with pytest.raises(Exception, match="different rows"):
        joins.join_predictions({"a": a, "b": b}).collect()


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(100).select(F.col("id").alias("request_id"), F.when(F.col("id") % 5 == 0, "attack").otherwise("valid").alias("label"))
    a, b = sampling.split_one_class(df, 30)
    ids = {r[0] for r in a.select("request_id").collect()}
    assert len(ids) == 30 and not ids & {r[0] for r in b.select("request_id").collect()} and b.count() == 70
    assert ids == {r[0] for r in sampling.split_one_class(df.repartition(7), 30)[0].select("request_id").collect()}


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([('{"request": "GET / HTTP/1.1", "label": "valid"}',), ("",), ("{bad",), ('{"label": "x"}',)], "value string")
    ok, bad = R.parse_requests(lines)
    assert ok.count() == 1 and bad.count() == 2
    log = spark.createDataFrame(
        [("GET", "/x", "HTTP/1.0", "UA", "h", "é", "1")],
        "request_http_method string, request_http_request string, request_http_protocol string, request_user_agent string, request_host string, request_body string, `000 - Normal` string",
    )
    for _, c in R.HEADER_COLUMNS:
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast("string"))
    r = R.requests_from_log(log).first()
    assert r["request"] == "GET /x HTTP/1.0\nUser-Agent: UA\nHost: h\nContent-Length: 2" and r["label"] == "valid"


def test_registry():
    r = Registry("thing")
    r.register("A", dict)
    assert r.get("a") is dict
    with pytest.raises(ValueError, match="already"):
        r.register("a", list)
    with pytest.raises(KeyError):
        r.get("b")


def test_flag_rate_monitor_covers_the_table(spark):
    """The streamed windows, the last ones too, are those of a batch over all events that can be normalised."""
    sf = "/root/testdata/sf0.001"
    batch = streams.flag_rate_monitor(normalize.normalize_requests(tables.requests(spark, sf)).where("error IS NULL")).collect()
    got = q_models.s4_flag_rate_monitor(spark, sf).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_run_complete_late_rows(spark, tmp_path):
    """Rows behind the watermark of an earlier batch count as well."""
    for k, ts in enumerate(["2024-01-01 12:00:00", "2024-01-01 00:00:00", "2024-01-01 12:01:00"]):
        spark.createDataFrame([(ts,)], "ts string").selectExpr("cast(ts as timestamp) ts").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    counts = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    got = streams.run_complete(counts.select("w.start", "n"), f"{tmp_path}/out").collect()
    assert sorted((r["start"].hour, r["n"]) for r in got) == [(0, 1), (12, 2)]


def test_flag_rate_job_bounds_its_state(spark, tmp_path):
    """Three batches, out of order: late rows are counted beside, closed windows leave the state, the sum is that of a batch job."""
    sf = "/root/testdata/sf0.001"
    rows = tables.requests(spark, sf).limit(120).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.monotonically_increasing_id() % 3 * 1800 + F.col("request_id") % 500))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    cuts = [F.col("ts") < F.timestamp_seconds(F.lit(1_700_001_000)), F.col("ts") >= F.timestamp_seconds(F.lit(1_700_003_000)), F.col("ts").between(F.timestamp_seconds(F.lit(1_700_001_001)), F.timestamp_seconds(F.lit(1_700_002_999)))]
    for k, cut in enumerate(cuts):
        rows.where(cut).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = f"{tmp_path}/out"
    streams.flag_rate_job(streams.stream_normalize(stream).where("error IS NULL"), path).awaitTermination()
    got = streams.flag_rates(spark, path).collect()
    want = streams.flag_rate_monitor(normalize.normalize_requests(spark.read.parquet(f"{tmp_path}/in/*")).where("error IS NULL")).collect()
    assert {(r["window_start"], r["family"]): r["n_flags"] + r["n_late"] for r in got} == {(r["window_start"], r["family"]): r["n_flags"] for r in want}
    assert sum(r["n_late"] for r in got) > 0 and sum(r["n_flags"] for r in got) > 0
    assert sorted(x.name for x in (tmp_path / "out/open").iterdir()) == ["batch=1", "batch=2"]
    mark = spark.read.parquet(f"{path}/mark/batch=2").first()["ts"]
    states = [spark.read.parquet(f"{path}/open/batch={b}").select("window_start").distinct().collect() for b in (1, 2)]
    assert all(r["window_start"].timestamp() + 600 > mark.timestamp() - 600 for r in states[1]) and all(1 <= len(s) <= 3 for s in states)


def test_stream_reports(spark, tmp_path):
    for k in range(3):
        spark.range(k + 1).selectExpr("repeat('x', int(id)) request", "array(3.0d, 4.0d * id) embedding").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("request string, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    log, kept = streams.BatchLog(), []
    spark.streams.addListener(log)
    try:
        streams.stream_batch_metrics(stream, lambda df, i: kept.append(df.first()), f"{tmp_path}/state").awaitTermination()
        total = log.totals()
    finally:
        spark.streams.removeListener(log)
    assert [r["n"] for r in kept] == [b["rows"] for b in log.batches] and sum(r["n"] for r in kept) == total["rows"] == 6 and total["batches"] == 3
    assert total["latency_max_ms"] >= total["latency_mean_ms"] > 0 and kept[-1]["norm_mean"] > 3
