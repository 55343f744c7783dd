"""Features, detectors, samples and metrics against NumPy and plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from requestlab.operators import detectors as D
from requestlab.operators import encoders, features, joins, metrics, neighbor_mi, neighbors, sampling, sparse_pca
from requestlab.operators import kernel_svm
from requestlab.operators.kernel_svm import KernelOneClassSVM
from requestlab.plans import grids, runs
from requestlab.sources import store


@pytest.fixture(scope="module")
def cloud():
    r = np.random.Generator(np.random.PCG64(5))
    x = r.standard_normal((300, 6)) @ r.standard_normal((6, 6)) + r.standard_normal(6)
    x[280:] += 6
    return x


@pytest.fixture(scope="module")
def vectors(spark, cloud):
    rows = [(i, "attack" if i >= 280 else "valid", v.tolist()) for i, v in enumerate(cloud)]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(5)


def scores(df):
    return np.array([r["score"] for r in df.orderBy("vec_id").collect()])


def test_moments_and_pca(vectors, cloud):
    n, mean, cov = features.mean_and_covariance(vectors)
    assert n == 300 and np.allclose(mean, cloud.mean(0)) and np.allclose(cov, np.cov(cloud.T))
    pca = features.PCA.fit(vectors, 3)
    values, axes = np.linalg.eigh(np.cov(cloud.T))
    got = np.array([r["embedding"] for r in pca.transform(vectors).orderBy("vec_id").collect()])
    want = (cloud - cloud.mean(0)) @ axes[:, ::-1][:, :3]
    assert np.allclose(np.abs(got), np.abs(want)) and np.allclose(pca.explained, values[::-1][:3] / values.sum())
    assert (pca.components[np.arange(3), np.abs(pca.components).argmax(axis=1)] > 0).all()
    two = features.pca_2d(vectors).orderBy("vec_id").collect()
    assert np.allclose(np.abs([[r["x"], r["y"]] for r in two]), np.abs(want[:, :2]))
    with pytest.raises(ValueError):
        features.mean_and_covariance(vectors.where("false"))


def test_mixture_is_em(vectors, cloud):
    """One iteration from the same start, by hand."""
    model = D.GaussianMixture(k=2, covariance="full", n_init=1, max_iter=1).fit(vectors)
    p = model.params
    means = D.GaussianMixture.starts(vectors, 2, 1, 42)[0]
    assert all((cloud == m).all(1).any() for m in means) and (means[0] != means[1]).any()
    cov = np.cov(cloud.T, bias=True) + 1e-6 * np.eye(6)
    diff = cloud[:, None] - means
    logp = -0.5 * np.einsum("nki,ij,nkj->nk", diff, np.linalg.inv(cov), diff)
    resp = np.exp(logp - logp.max(1, keepdims=True))
    resp /= resp.sum(1, keepdims=True)
    nk = resp.sum(0)
    assert np.allclose(p["weights"], nk / 300) and np.allclose(p["means"], resp.T @ cloud / nk[:, None])
    k = 1
    d = cloud - p["means"][k]
    assert np.allclose(p["covs"][k], (resp[:, k, None] * d).T @ d / nk[k] + 1e-6 * np.eye(6))
    logn = [math.log(w) - 0.5 * (6 * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", cloud - m, np.linalg.inv(c), cloud - m)) for w, m, c in zip(p["weights"], p["means"], p["covs"], strict=True)]
    assert np.allclose(scores(model.score(vectors)), -np.logaddexp(*logn))


def test_forest_paths(vectors, cloud):
    """Scores follow from the saved trees, walked row by row."""
    model = D.IsolationForest(n_estimators=7, max_samples=64).fit(runs.normal(vectors))
    trees = [np.reshape(t, (-1, 5)) for t in model.params["trees"]]

    def path(tree, x):
        at = 0
        while tree[at, 0] >= 0:
            at = int(tree[at, 2] if x[int(tree[at, 0])] < tree[at, 1] else tree[at, 3])
        return tree[at, 4]

    want = [2 ** -(np.mean([path(t, x) for t in trees]) / float(D.average_path(64))) for x in cloud]
    assert np.allclose(scores(model.score(vectors)), want) and np.mean(want[280:]) > np.mean(want[:280])


def test_one_class_svm_keeps_nu(vectors):
    model = D.OneClassSVM(nu=0.1, n_features=64, max_iter=10).fit(runs.normal(vectors))
    got = scores(model.score(vectors))
    assert abs((got[:280] > 0).mean() - 0.1) < 0.01 and (got[280:] > 0).mean() > 0.9


def test_outlier_factor(vectors, cloud, spark, tmp_path):
    k, valid = 10, cloud[:280]
    dist = np.linalg.norm(cloud[:, None] - valid[None], axis=2)
    inner = dist[:280].copy()
    np.fill_diagonal(inner, np.inf)
    near = np.argsort(inner, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(inner, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(inner, near, 1), kd[near]).mean(1) + 1e-10)
    mine = np.argsort(dist, axis=1, kind="stable")[:, :k]
    own = 1 / (np.maximum(np.take_along_axis(dist, mine, 1), kd[mine]).mean(1) + 1e-10)
    model = D.LocalOutlierFactor(k).fit(runs.normal(vectors))
    assert np.allclose(scores(model.score(vectors)), lrd[mine].mean(1) / own - 1.5, atol=1e-6)
    cut, fpr = model.set_threshold(runs.normal(vectors))
    assert fpr <= 0.06
    path = (tmp_path / "lof").as_uri()
    model.save(spark, path)
    again = D.load(spark, path)
    assert again.threshold == cut and np.allclose(scores(again.score(vectors)), scores(model.score(vectors)))


def test_pca_detector_round_trip(vectors, spark, tmp_path):
    for inner in (D.RidgeMahalanobis(), D.LocalOutlierFactor(5)):
        model = D.PcaDetector(inner, 3).fit(runs.normal(vectors))
        model.threshold = 1.25
        path = (tmp_path / inner.name).as_uri()
        model.save(spark, path)
        again = D.load(spark, path)
        assert again.threshold == 1.25 and np.allclose(scores(again.score(vectors)), scores(model.score(vectors)))
    with pytest.raises(D.NotFitted):
        D.PcaDetector(D.Mahalanobis(), 2).save(spark, path)


def test_percentiles(spark, monkeypatch):
    """Exact with brackets (more rows than BRACKET), ties, small groups, null groups and null values."""
    r = np.random.Generator(np.random.PCG64(1))
    rows = [("big", float(x)) for x in r.standard_normal(3000)] + [("tied", float(x)) for x in r.integers(0, 3, 2500)]
    rows += [(None, 1.0), (None, 2.0), (None, None), ("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    shares = [0.0, 0.013, 0.5, 0.95, 0.999, 1.0]
    for bracket in (10_000, 200):
        monkeypatch.setattr(metrics, "BRACKET", bracket)
        got = {x["g"]: list(x)[1:] for x in metrics.percentiles(df, "x", shares, ["g"]).collect()}
        assert set(got) == {"big", "tied", "one", None}
        for g, values in got.items():
            assert np.allclose(values, np.quantile([v for k, v in rows if k == g and v is not None], shares))
        assert np.isclose(metrics.percentile(df, "x", 0.3), np.quantile([v for _, v in rows if v is not None], 0.3))
    assert metrics.percentile(df.where("false"), "x", 0.5) is None


def test_samples(spark):
    rows = [(i, "ab"[i % 3 == 0], int(i % 2 == 0), int(i % 5 == 0)) for i in range(0, 3000, 3)] + [(i, None, 0, 1) for i in range(4000, 4020)]
    df = spark.createDataFrame(rows, "request_id long, label string, x int, y int").repartition(4)
    order = lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i)
    by = {g: sorted((i for i, k, *_ in rows if k == g), key=order) for g in {r[1] for r in rows}}
    for n in (1, 17, 400, 5000):
        got = {(r["request_id"], r["label"], r["population"]) for r in sampling.sample_per_label(df, n).collect()}
        assert got == {(i, g, len(v)) for g, v in by.items() for i in v[:n]}
    got = {r["request_id"] for r in sampling.sample_per_category(df, ["x", "y"], 0.15).collect()}
    want = set()
    for c in (2, 3):
        own = sorted((r[0] for r in rows if r[c]), key=order)
        want |= set(own[: max(1, int(len(own) * 0.15))])
    assert got == want
    assert sampling.sample_per_label(df.where("false"), 5).count() == 0
    ids = sorted(r[0] for r in rows)
    assert sorted(r["request_id"] for r in sampling.every_nth(df, 7).collect()) == ids[6::7]


def test_pooling(spark):
    r = np.random.Generator(np.random.PCG64(3))
    rows = [(f"r{i % 7}", i, r.standard_normal(5).tolist(), r.standard_normal(5).tolist(), i % 9 == 0) for i in range(200)] + [("r1", 999, None, None, False)]
    df = spark.createDataFrame(rows, "request_id string, token_pos long, vec array<double>, other array<double>, is_special boolean").repartition(4)
    own = {k: [(np.array(v), np.array(o)) for key, _, v, o, s in rows if key == k and not s and v] for k in {x[0] for x in rows}}
    for layers in (None, ("vec", "other")):
        for x in features.pool_tokens(df, layers=layers).collect():
            m = np.array([(v + o) / 2 if layers else v for v, o in own[x["request_id"]]])
            assert np.allclose(x["embedding"], np.concatenate([m.mean(0), m.max(0)]))
    planes = features.fde_projections(5, 3, 2, 4, 42)
    got = features.multi_vector_fde(df, reps=3, k_sim=2, dim=4).collect()
    assert len(got) == 7
    for x in got:
        v, out = np.array([v for v, _ in own[x["request_id"]]]), np.zeros((3, 4, 4))
        for i, (a, b) in enumerate(planes):
            bucket = ((v @ a) > 0) @ [1, 2]
            for s in set(bucket):
                out[i, s] = (v[bucket == s] @ b).mean(0)
        assert np.allclose(x["embedding"], out.ravel())


def test_mutual_information(spark, vectors, cloud):
    """The native estimator with bins against counts, the nearest-neighbour one on independent and dependent numbers."""
    y = np.array([i >= 280 for i in range(300)])
    for x in features.mi_continuous(vectors, bins=4).collect():
        v = cloud[:, x["dim"]]
        b = (np.quantile(v, [0.25, 0.5, 0.75])[None] < v[:, None]).sum(1)
        want = sum(p * math.log(p / ((b == i).mean() * (y == j).mean())) for i in range(4) for j in (0, 1) if (p := ((b == i) & (y == j)).mean()))
        assert x["mi"] == pytest.approx(max(0, want))
    r = np.random.Generator(np.random.PCG64(0))
    v, c = r.standard_normal(2000), r.integers(0, 2, 2000)
    assert features.nearest_mi(v, c, 3) < 0.03 and features.nearest_mi(v + 20 * c, c, 3) == pytest.approx(math.log(2), abs=0.02)


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbor_information(spark, parts):
    """Ranges with halos against one group: ties, hot values, tiny classes, values of all sizes, any number of ranges."""
    r = np.random.Generator(np.random.PCG64(parts))
    n = 400
    y = np.array(["a", "b", "c", "one", "two", "two"])[np.minimum(5, np.append(r.integers(0, 3, n - 3), [3, 4, 5]))]
    cols = [
        r.standard_normal(n), r.integers(0, 5, n).astype(float), np.where(r.random(n) < 0.4, 0.0, r.standard_normal(n)), np.zeros(n),
        r.standard_normal(n) * 10.0 ** r.integers(-300, 300, n), np.float32(r.standard_normal(n)).astype(float), np.round(r.standard_normal(n), 1) + (y == "a"),
        np.where(y == "a", 1e9, -1e9) + r.random(n), r.integers(-3, 4, n) * 0.1,
    ]
    x = np.stack(cols, axis=1)
    rows = [(i, k, v.tolist()) for i, (k, v) in enumerate(zip(y.tolist(), x, strict=True))] + [(n, "a", None), (n + 1, None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {g["dim"]: g["mi"] for g in features.mi_continuous(df, bins=None).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(cols)
    for d, v in enumerate(cols):
        assert got[d] == pytest.approx(features.nearest_mi(v, y, 3), abs=1e-9), d
    assert features.mi_continuous(df.where("false"), bins=None).count() == 0


def test_ball_ends():
    """The end of a ball is settled by distances, at every scale."""
    r = np.random.Generator(np.random.PCG64(2))
    x = np.concatenate([r.standard_normal(300) * 10.0 ** r.integers(-200, 200, 300), [-1.0, 0.0, -3.0]])
    d = np.concatenate([np.abs(r.standard_normal(300)) * 10.0 ** r.integers(-200, 200, 300), [1.0, 5e-324, 3.0]])
    d = np.maximum(d, np.abs(np.spacing(x)))
    b = neighbor_mi.first_at(x, d)
    assert (b > x).all() and (b - x >= d).all() and (np.nextafter(b, -np.inf) - x < d).all()


def test_pruned_neighbors(spark):
    """Clustered vectors: the lists of all pairs, by few visits; repeated vectors, ties, hot blocks and null vectors."""
    r = np.random.Generator(np.random.PCG64(4))
    x = np.repeat(r.standard_normal((12, 5)) * 30, 40, axis=0) + r.standard_normal((480, 5))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    old = neighbors.GROUP
    neighbors.GROUP = 50
    try:
        for k, block, own in ((3, 16, True), (5, 16, False), (4, 10_000, True), (600, 32, True)):
            seen = {}
            got = joins.nearest_neighbors(df, df, k, block=block, skip_self=own, seen=seen).collect()
            d = dist.copy()
            if own:
                np.fill_diagonal(d, np.inf)
            best = np.argsort(d, axis=1, kind="stable")[:, : min(k, 479)]
            assert {(g["id"], g["rank"]): g["neighbor"] for g in got} == {(i, j + 1): int(best[i, j]) for i in range(480) for j in range(best.shape[1])}
            assert all(g["distance"] == dist[g["id"], g["neighbor"]] for g in got)
            if k < 10 and seen:
                assert seen["visits"] < 0.4 * seen["possible"]
    finally:
        neighbors.GROUP = old
    assert joins.nearest_neighbors(df, df.where("false"), 2).count() == 0


def test_sparse_pca(spark):
    """Explained variance and coordinates of a wide sparse table against the dense fit; rows without a weight count."""
    r = np.random.Generator(np.random.PCG64(6))
    x = np.where(r.random((200, 600)) < 0.05, r.random((200, 600)), 0) + np.outer(r.random(200) < 0.3, np.where(r.random(600) < 0.1, 2.0, 0))
    x[:5] = 0
    long = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    weights = spark.createDataFrame(long, "doc_id long, idx long, weight double").repartition(4)
    docs = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    pca = sparse_pca.fit(weights, 200, 600, 8, passes=60, tol=1e-7)
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(pca.explained, values[::-1][:8] / values.sum(), atol=1e-3) and np.allclose(pca.components @ pca.components.T, np.eye(8))
    got = np.array([g["embedding"] for g in sparse_pca.transform(pca, docs, weights).orderBy("doc_id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ pca.components.T) and np.allclose(np.abs(got[:, 0]), np.abs((x - x.mean(0)) @ axes[:, -1]), atol=1e-3)
    with pytest.raises(ValueError):
        sparse_pca.fit(weights, 200, 10**7, 300)


def test_forest_draws_rows(spark, vectors):
    """The same trees however rows are dealt; one vector repeated often is drawn by its rows, equal rows by their count."""
    a, b = (D.IsolationForest(n_estimators=5, max_samples=32).fit(v).params["trees"] for v in (vectors, vectors.repartition(11, "vec_id")))
    assert all(np.array_equal(p, q) for p, q in zip(a, b, strict=True))
    many = spark.range(200_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 199_000, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(0.0))).alias("embedding"))
    model = D.IsolationForest(n_estimators=5, max_samples=32)
    picked = model._samples(many, 200_000, 5, 32, 42)
    assert picked.count() < 5 * 200 and picked.agg(F.max("c")).first()[0] == 1
    same = many.where("vec_id < 199000").select("embedding")
    assert model._samples(same, 199_000, 5, 32, 42).count() == 5
    assert len(model.fit(same).params["trees"]) == 5


def test_starts_lie_apart(spark):
    rows = [([0.0, 0.0],)] * 500 + [([9.0, 9.0],)] * 20 + [([9.0, -9.0],)] * 3 + [(None,)]
    df = spark.createDataFrame(rows, "embedding array<double>").repartition(3)
    for means in D.GaussianMixture.starts(df.where("embedding IS NOT NULL"), 3, 4, 7):
        assert sorted(map(tuple, means)) == [(0.0, 0.0), (9.0, -9.0), (9.0, 9.0)]
    assert len(D.GaussianMixture(k=5, n_init=2, max_iter=2, covariance="diag").fit(df).params["weights"]) == 3


def test_no_vector_no_score(spark, vectors):
    df = vectors.select("vec_id", "embedding").unionByName(spark.createDataFrame([(1000, None)], "vec_id long, embedding array<double>"))
    for model in (D.Mahalanobis(), D.LocalOutlierFactor(5), D.PcaDetector(D.Hypersphere(), 2), D.IsolationForest(n_estimators=3)):
        got = {r["vec_id"]: r["score"] for r in model.fit(runs.normal(vectors)).score(df).collect()}
        assert len(got) == 301 and got[1000] is None and sum(x is None for x in got.values()) == 1


def test_groups_stay_where_they_are(spark):
    """No exchange of input rows: percentiles, thresholds and samples by group send a row a group to the rows."""
    df = spark.range(2_000_000_000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 20 == 0, "attack").otherwise("valid").alias("label"), F.rand(1).alias("score"))
    side = spark.createDataFrame([("valid", 1, "a", 5)], "_g string, population long, h string, k long")
    side = store.beside(store.materialize(side, "side"))
    plan = df.join(side, F.col("label").eqNullSafe(F.col("_g")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    small = df.where("request_id < 5000")
    for got in (sampling.sample_per_label(small, 10), metrics.predict(small, metrics.threshold_at_fpr(small, 0.05, ["label"]), ["label"]), *sampling.split_one_class(small, 100)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_encoders(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb aa", 0), (2, "bb cc", 1), (3, "zz", 2), (4, None, 3)], "doc_id long, text string, extra int")
    model = encoders.TfidfEncoder(max_features=2).fit(docs.where("doc_id < 3"))
    path = (tmp_path / "enc").as_uri()
    model.save(spark, path)
    got = {r["doc_id"]: r["embedding"] for r in encoders.load(spark, path).encode(docs).collect()}
    w = np.array([2 * (math.log(3 / 2) + 1), 1.0])
    assert np.allclose(got[1], w / np.linalg.norm(w)) and got[2] == [0.0, 1.0] and got[3] == got[4] == [0.0, 0.0]
    assert encoders.load(spark, path).encode(docs).columns == ["doc_id", "text", "extra", "embedding"]
    flags = spark.createDataFrame([(1, ["A", "B", "A"]), (2, [])], "request_id long, all_flags array<string>")
    assert [r["embedding"] for r in encoders.FlagEncoder(["A", "C"]).encode(flags).orderBy("request_id").collect()] == [[2.0, 0.0], [0.0, 0.0]]


def test_grid_ends_in_a_choice(vectors):
    got = runs.tuned_run(vectors, D.Hypersphere, {"nu": [0.01, 0.2]})
    best, again = got["best"].first(), got["refit"].first()
    assert got["grid"].count() == 2 and got["frontier"].count() >= 1
    assert (best["recall"], best["fpr"], best["nu"]) == (again["recall"], again["fpr"], again["nu"])


def test_batches(spark):
    rows = [(f"id{i:03d}", "x" * (i % 5), [3.0, 4.0], i) for i in range(0, 90, 2)]
    df = spark.createDataFrame(rows, "request_id string, request string, embedding array<double>, t long").repartition(4)
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = metrics.batch_metrics(df, 10, start="ts", end="ts").orderBy("batch").collect()
    assert [r["n"] for r in got] == [10, 10, 10, 10, 5] and [r["seen"] for r in got] == [10, 20, 30, 40, 45]
    assert got[0]["latency_ms"] == 18_000 and got[0]["norm_mean"] == 5 and got[0]["len_mean"] == np.mean([len(r[1]) for r in rows[:10]])
    total = metrics.run_totals(metrics.batch_metrics(df, 10, start="ts", end="ts")).first()
    assert (total["batches"], total["rows"], total["latency_max_ms"]) == (5, 45, 18_000)


def test_grid_is_its_members(vectors, cloud):
    """Models fitted and evaluated together are those fitted alone."""
    normal = runs.normal(vectors)
    for cls, options in (
        (D.IsolationForest, [{"n_estimators": t, "max_samples": m} for t, m in ((3, 64), (3, 16), (7, 64))]),
        (D.GaussianMixture, [{"k": k, "n_init": 2, "max_iter": 3, "covariance": c} for k, c in ((1, "full"), (3, "diag"), (2, "tied"))]),
        (D.OneClassSVM, [{"nu": n, "gamma": g, "n_features": 16, "max_iter": 3} for n, g in ((0.05, "scale"), (0.2, 0.1))]),
    ):
        models = grids.fit_all(cls, normal, options)
        rows = grids.score_arrays(vectors, grids.scorers(models)).orderBy("vec_id").collect()
        for i, (m, o) in enumerate(zip(models, options, strict=True)):
            alone = scores((cls(**o).fit(normal) if i == 1 else m).score(vectors))
            assert np.allclose([r["scores"][i] for r in rows], alone, rtol=1e-6), (cls, o)
    got = {r["run_id"]: r for r in runs.grid_run(vectors, D.IsolationForest, {"n_estimators": [3, 7], "max_samples": [16, 64]}).collect()}
    for i, (t, m) in ((1, (3, 64)), (2, (7, 16))):
        one = runs.evaluate(D.IsolationForest(n_estimators=t, max_samples=m).fit(normal).score(vectors)).first()
        assert all(got[i][c] == pytest.approx(one[c]) for c in ("tp", "fp", "tn", "fn", "threshold", "recall"))


def test_forest_search(vectors):
    got = grids.forest_search(vectors, [4, 9], [None, 32], [0.05, 0.3]).collect()
    assert len(got) == 8 and sorted(r["run_id"] for r in got) == list(range(8))
    for r in [x for x in got if x["run_id"] in (0, 3, 6)]:
        model = D.IsolationForest(n_estimators=r["n_estimators"], max_samples=r["max_samples"] or 256, contamination=r["contamination"]).fit(runs.normal(vectors))
        want = metrics.confusion_matrix(model.predict(vectors)).first()
        assert r["threshold"] == pytest.approx(model.params["offset"]) and all(r[c] == want[c] for c in ("tp", "fp", "tn", "fn"))


@pytest.mark.parametrize("working", [40, 1000])
def test_kernel_svm(spark, vectors, cloud, working, tmp_path):
    """The optimum of the whole dual, by its conditions over the full kernel matrix; null vectors; a saved model."""
    df = runs.normal(vectors).unionByName(spark.createDataFrame([(999, "valid", None)], vectors.schema))
    model = KernelOneClassSVM(nu=0.1, gamma=0.05, working=working, tol=1e-4).fit(df)
    p, x = model.params, cloud[:280]
    k = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(2))
    alpha = np.zeros(280)
    for v, a in zip(p["vectors"], p["alpha"], strict=True):
        alpha[np.flatnonzero((x == v).all(1))[0]] = a
    g = k @ alpha
    assert alpha.sum() == pytest.approx(28) and (alpha >= 0).all() and (alpha <= 1).all()
    assert g[alpha > 0].max() - g[alpha < 1].min() <= 2e-4
    far = np.exp(-0.05 * ((cloud[:, None] - x[None]) ** 2).sum(2)) @ alpha
    rho = g[(alpha > 0) & (alpha < 1)].mean()
    assert np.allclose(scores(model.score(vectors)), rho - far, atol=1e-3)
    path = (tmp_path / "svm").as_uri()
    model.save(spark, path)
    assert np.allclose(scores(D.load(spark, path).score(vectors)), scores(model.score(vectors)))


def test_kernel_svm_of_a_spread_dual_settles(spark):
    """Unit vectors in near copies, nearly all of them free support vectors: the working rows grow, so few rounds are enough."""
    r = np.random.Generator(np.random.PCG64(5))
    x = np.repeat(r.standard_normal((200, 16)), 3, axis=0) + 0.05 * r.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = KernelOneClassSVM(nu=0.1, gamma=1.0, working=20, max_rounds=25).fit(df).params
    alpha = np.zeros(600)
    for v, a in zip(p["vectors"], p["alpha"], strict=True):
        alpha[np.flatnonzero((x == v).all(1))[0]] = a
    g = np.exp(-((x[:, None] - x[None]) ** 2).sum(2)) @ alpha
    assert alpha.sum() == pytest.approx(60) and (alpha >= 0).all() and (alpha <= 1).all() and len(p["alpha"]) > 200
    assert g[alpha > 0].max() - g[alpha < 1].min() <= 1.1e-3


def test_kernel_svm_takes_free_rows_at_once(spark, monkeypatch):
    """More free rows than a kernel matrix has room for: the tasks multiply by the kernel, so few rounds are enough; one row is repeated."""
    monkeypatch.setattr(kernel_svm, "WORKING", 60)
    r = np.random.Generator(np.random.PCG64(6))
    x = np.repeat(r.standard_normal((200, 16)), 3, axis=0) + 0.05 * r.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[500:] = x[500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = KernelOneClassSVM(nu=0.1, gamma=1.0, working=40, max_rounds=8).fit(df).params
    v, alpha = p["vectors"], p["alpha"]
    assert alpha.sum() == pytest.approx(60) and (alpha > 0).all() and (alpha <= 1).all() and len(alpha) > 200
    kernel = lambda y: np.exp(-((x[:, None] - y[None]) ** 2).sum(2))
    g = kernel(v) @ alpha
    held = (x[:, None] == v[None]).all(2)
    some = held.any(1)  # rows of the model, and the copies of one of them
    below = np.array([(alpha[h] < 1).any() or h.sum() < (x == y).all(1).sum() for h, y in zip(held, x, strict=True)])
    assert g[some].max() - g[below].min() <= 1.1e-3
