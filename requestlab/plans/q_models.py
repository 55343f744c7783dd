"""Registered queries: features, detectors, streams and runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from requestlab.operators import detectors as D
from requestlab.operators import encoders, features, sampling
from requestlab.operators.kernel_svm import KernelOneClassSVM
from requestlab.sources import requests as R
from requestlab.streaming import streams

from . import registry, runs
from .q_eval import METRIC_SQL, TERM, TERMS, VEC, rounded, terms
from .q_requests import _FAMILY, FLAGS, folder, long_flags, normalized
from .tables import REQUESTS_SQL, requests, table, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


VOCAB = f"""{TERMS}, nd AS (SELECT count(*) AS n FROM documents), voc AS (SELECT term, df, tf, row_number() OVER (ORDER BY term) - 1 AS idx FROM
  (SELECT term, count(*) AS df, sum(tf) AS tf FROM terms GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT n FROM nd) ORDER BY tf DESC, term LIMIT 200))"""


def vocabulary(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return features.build_vocabulary(terms(spark, sf_dir), n, 5, 0.9, 200), n


# ---- E -----------------------------------------------------------------------------------


@query(f"""SELECT doc_id, coalesce(len(t), 0) AS n_words, coalesce(len(t) + greatest(len(t) - 1, 0), 0) AS n_grams, md5(coalesce(array_to_string(t, ' '), '')) AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS t FROM documents)""")
def e1_tokenize(spark, sf_dir):
    words = features.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.size(features.tokenize(F.col("text"), n=2)).cast("long").alias("n_grams"),
        F.md5(F.array_join(words, " ")).alias("words"),
    )


@query(f"WITH {VOCAB} SELECT term, idx, df, tf FROM voc")
def e2_build_vocabulary(spark, sf_dir):
    return vocabulary(spark, sf_dir)[0].select("term", F.col("idx").cast("long").alias("idx"), "df", "tf")


@query(f"WITH {VOCAB} SELECT doc_id, idx, terms.tf FROM terms JOIN voc USING (term)")
def e3_count_vectors(spark, sf_dir):
    voc, _ = vocabulary(spark, sf_dir)
    return features.count_vectors(terms(spark, sf_dir), voc).select("doc_id", F.col("idx").cast("long").alias("idx"), "tf")


@query(f"""WITH {VOCAB}, w AS (SELECT doc_id, idx, terms.tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM terms JOIN voc USING (term), nd)
SELECT doc_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 5) AS weight FROM w""")
def e4_tfidf(spark, sf_dir):
    voc, n = vocabulary(spark, sf_dir)
    got = features.tfidf(terms(spark, sf_dir), voc, n)
    return got.select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("weight", 5).alias("weight"))


@query(f"WITH {VOCAB}, sel AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT term FROM voc ORDER BY df DESC, term LIMIT 20)) SELECT doc_id, idx, tf FROM terms JOIN sel USING (term)")
def e5_bow_select(spark, sf_dir):
    voc, _ = vocabulary(spark, sf_dir)
    from pyspark.sql import Window as W

    top = sampling.top_k(voc.select("term", "df"), "df", 20, "term").withColumn("idx", F.row_number().over(W.orderBy("term")) - 1)
    return features.count_vectors(terms(spark, sf_dir), top).select("doc_id", F.col("idx").cast("long").alias("idx"), "tf")


LANG = "lab AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'valid' ELSE 'attack' END AS label FROM documents)"


@query(f"""WITH {VOCAB}, {LANG}, tot AS (SELECT label, count(*) AS nl FROM lab GROUP BY 1), n AS (SELECT count(*) AS n FROM lab),
c0 AS (SELECT term, terms.tf AS v, label, count(*) AS c FROM terms JOIN voc USING (term) JOIN lab USING (doc_id) GROUP BY ALL),
z AS (SELECT t.term, 0 AS v, tot.label, nl - coalesce(s.c, 0) AS c FROM (SELECT DISTINCT term FROM c0) t CROSS JOIN tot LEFT JOIN (SELECT term, label, sum(c) AS c FROM c0 GROUP BY ALL) s ON s.term = t.term AND s.label = tot.label),
cc AS (SELECT * FROM c0 UNION ALL SELECT * FROM z WHERE c > 0), cv AS (SELECT *, sum(c) OVER (PARTITION BY term, v) AS nv FROM cc)
SELECT term, round(greatest(sum(c / n * ln(c * n / (nv * nl))), 0), 5) AS mi FROM cv JOIN tot USING (label), n GROUP BY term""")
def e6_mi_discrete(spark, sf_dir):
    voc, _ = vocabulary(spark, sf_dir)
    counts = features.count_vectors(terms(spark, sf_dir), voc)
    lab = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "valid").otherwise("attack").alias("label"))
    return features.mi_discrete(counts, lab, "tf").select("term", F.round("mi", 5).alias("mi"))


def mi_sql(rows: str, bins: int = 16) -> str:
    """Mutual information of quantile bins with the class: dim (from 0), mi."""
    cuts = ", ".join(f"{i / bins}" for i in range(1, bins))
    return f"""SELECT CAST(d - 1 AS INT) AS dim, greatest(sum(c / n * ln(c * n / (nb * nl))), 0) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY d) AS n, sum(c) OVER (PARTITION BY d, b) AS nb, sum(c) OVER (PARTITION BY d, label) AS nl FROM
  (SELECT d, label, len(list_filter(cuts, lambda q: q < x)) AS b, count(*) AS c FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM ({rows}))
   JOIN (SELECT d, quantile_cont(CAST(x AS DOUBLE), [{cuts}]) AS cuts FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM ({rows})) GROUP BY d) USING (d) GROUP BY ALL)) GROUP BY d"""


@query(f"WITH {VEC} SELECT dim, round(mi, 6) AS mi FROM ({mi_sql('FROM vec')})")
def e7_mi_continuous(spark, sf_dir):
    return features.mi_continuous(vectors(spark, sf_dir)).select("dim", F.round("mi", 6).alias("mi"))


def nearest_mi_sql(rows: str, k: int = 3) -> str:
    """The neighbour estimator: radii by lag and lead inside a class, counts within them by distances, digamma by harmonic numbers."""
    around = ", ".join(f"abs(x - {f}(x, {i}) OVER w)" for i in range(1, k + 1) for f in ("lag", "lead"))
    return f"""l AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM ({rows})),
r AS (SELECT d, x, nc, least({k}, nc - 1) AS near, list_sort(list_filter(a, lambda z: z IS NOT NULL))[least({k}, nc - 1)] AS r FROM (SELECT d, x, count(*) OVER (PARTITION BY d, label) AS nc, [{around}] AS a FROM l WINDOW w AS (PARTITION BY d, label ORDER BY x)) WHERE nc > 1),
m AS (SELECT r.d, nc, near, (SELECT count(*) FROM l WHERE l.d = r.d AND (abs(l.x - r.x) < r.r OR l.x = r.x)) AS m FROM r),
h AS (SELECT i AS n, sum(1.0::DOUBLE / (i - 1)) OVER (ORDER BY i) AS psi FROM range(2, (SELECT 2 + count(*) FROM l WHERE d = 0)) t(i) UNION ALL SELECT 1, 0.0)
SELECT CAST(d AS INT) AS dim, round(greatest(a.psi + s, 0), 6) AS mi FROM (SELECT d, count(*) AS n, avg(k.psi - c.psi - p.psi) AS s FROM m JOIN h k ON k.n = near JOIN h c ON c.n = nc JOIN h p ON p.n = m GROUP BY d) JOIN h a USING (n)"""


@query(f"WITH {VEC}, {nearest_mi_sql('FROM vec')}")
def e7_mi_neighbors(spark, sf_dir):
    return features.mi_continuous(vectors(spark, sf_dir), bins=None).select("dim", F.round("mi", 6).alias("mi"))


@query(f"WITH {VOCAB} SELECT term, df FROM voc ORDER BY df DESC, term LIMIT 25")
def e8_select_top_k(spark, sf_dir):
    return sampling.top_k(vocabulary(spark, sf_dir)[0].select("term", "df"), "df", 25, "term")


@query()
def e9_pca(spark, sf_dir):
    v = vectors(spark, sf_dir)
    got = features.PCA.fit(runs.normal(v), 8).transform(v)
    return got.select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("coords"))


@query(f"""WITH {VEC}, d AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vec WHERE label = 'valid')
SELECT 64 AS dims, round(sum(v), 6) AS variance, true AS uncorrelated, true AS descending, true AS complete FROM (SELECT var_samp(CAST(x AS DOUBLE)) AS v FROM d GROUP BY i)""")
def e9_pca_properties(spark, sf_dir):
    """What defines principal components: coordinates that do not correlate, in the order of their variance, which together is all there is."""
    v = runs.normal(vectors(spark, sf_dir))
    n, mean, cov = features.mean_and_covariance(features.PCA.fit(v, 64).transform(v))
    own = cov.diagonal()
    facts = (len(own), round(float(own.sum()), 6), *map(bool, (abs(cov - np.diag(own)).max() < 1e-9, (own[1:] <= own[:-1] + 1e-9).all(), abs(mean).max() < 1e-9)))
    return spark.createDataFrame([facts], "dims int, variance double, uncorrelated boolean, descending boolean, complete boolean")


@query()
def e9_sparse_pca(spark, sf_dir):
    """Components of TF-IDF features of more than 5,000 terms: the share of the variance that each explains."""
    pca, coords = runs.text_pca(labelled_texts(spark, sf_dir), 10_000, 20, n=2)
    spread = coords.where("label = 'valid'").select(F.posexplode("embedding").alias("component", "x")).groupBy("component").agg(F.round(F.var_samp("x"), 6).alias("variance"))
    share = F.get(F.lit([round(float(x), 6) for x in pca.explained]), F.col("component"))
    return spread.select("component", "variance", share.alias("share"), F.lit(len(pca.mean)).alias("terms"))


def labelled_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "valid").otherwise("attack").alias("label"))


@query()
def e10_pca_2d(spark, sf_dir):
    return features.pca_2d(vectors(spark, sf_dir)).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def token_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 50).alias("request_id"), F.col("vec_id").alias("token_pos"), F.col("embedding").alias("vec"), (F.col("vec_id") % 10 == 9).alias("is_special")
    )


@query("""SELECT request_id, round(avg(x), 5) AS first_mean, round(max(x), 5) AS first_max, 128 AS dims FROM (SELECT vec_id % 50 AS request_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 <> 9) GROUP BY 1""")
def e11_pool_tokens(spark, sf_dir):
    p = features.pool_tokens(token_vectors(spark, sf_dir))
    e = F.col("embedding")
    return p.select("request_id", F.round(e[0], 5).alias("first_mean"), F.round(e[64], 5).alias("first_max"), F.size(e).alias("dims"))


@query()
def e12_multi_vector_fde(spark, sf_dir):
    got = features.multi_vector_fde(token_vectors(spark, sf_dir))
    return got.select("request_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


@query(f"""{FLAGS} SELECT request_id, count(*) FILTER (flag = 'ANGLE') AS angle, count(*) FILTER (flag = 'WSPAD') AS wspad, count(*) FILTER (flag = 'QBARE') AS qbare FROM flg GROUP BY 1""")
def e13_flag_features(spark, sf_dir):
    return features.flag_features(long_flags(spark, sf_dir), ["ANGLE", "WSPAD", "QBARE"])


def gauss(name: str, rows: str, ddof: int = 0, ridge: float = 0.0, column: str = "embedding") -> str:
    """CTEs of a Gaussian fit over the vectors of ``rows`` (one row ``<name>_fit``: mean ``m``, precision ``p``).

    The covariance is inverted by Gauss-Jordan steps, one a recursion.
    """
    return f"""{name}_v AS ({rows}), {name}_l AS (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM (SELECT row_number() OVER () AS rid, {column} AS v FROM {name}_v)),
{name}_m AS (SELECT d, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM {name}_l GROUP BY d), {name}_c AS (SELECT rid, d, x - m AS x FROM {name}_l JOIN {name}_m USING (d)),
{name}_cov AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) / ((SELECT max(n) FROM {name}_m) - {ddof}) + CASE WHEN a.d = b.d THEN {ridge} ELSE 0 END AS c FROM {name}_c a JOIN {name}_c b USING (rid) GROUP BY a.d, b.d),
{name}_a AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list_concat(list(c ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY j)) AS r FROM {name}_cov GROUP BY i)),
{name}_g AS (SELECT 1 AS k, a FROM {name}_a UNION ALL SELECT k + 1, list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / a[k][k])
  ELSE list_transform(list_zip(r, a[k]), lambda z: z[1] - r[k] * z[2] / a[k][k]) END) FROM {name}_g WHERE k <= len(a)),
{name}_fit AS (SELECT (SELECT list(m ORDER BY d) FROM {name}_m) AS m, list_transform(a, lambda r: r[len(a) + 1:]) AS p FROM {name}_g WHERE k = len(a) + 1)"""


def squared(name: str, rows: str, column: str = "embedding") -> str:
    """Squared Mahalanobis distances of ``rows`` under a fit, as column ``d2``."""
    diff = f"list_transform(list_zip({column}, m), lambda z: CAST(z[1] AS DOUBLE) - z[2])"
    return f"SELECT * EXCLUDE (_d, p), list_sum(list_transform(p, lambda r, i: _d[i] * list_dot_product(r, _d))) AS d2 FROM (SELECT t.*, p, {diff} AS _d FROM ({rows}) t, {name}_fit)"


def at_fpr(scored: str, extra: str = "") -> str:
    """One row of metrics at the threshold that keeps 5 % of the valid rows; ``scored`` has label and score."""
    return f"""SELECT tp, fp, tn, fn, {METRIC_SQL}, round(threshold, 6) AS threshold{extra} FROM (SELECT threshold, count(*) FILTER (score > threshold AND label = 'attack') AS tp, count(*) FILTER (score > threshold AND label = 'valid') AS fp,
  count(*) FILTER (score <= threshold AND label = 'valid') AS tn, count(*) FILTER (score <= threshold AND label = 'attack') AS fn FROM ({scored}), (SELECT quantile_cont(score, 0.95) AS threshold FROM ({scored}) WHERE label = 'valid') GROUP BY threshold)"""


NEAREST = f"""{VEC}, nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS r FROM (SELECT t.vec_id AS id, t.label, n.vec_id AS neighbor,
  sqrt(list_sum(list_transform(list_zip(t.embedding, n.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))) AS distance FROM vec t JOIN vec n ON n.label = 'valid')),
nx AS (SELECT id, label, neighbor, distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS r FROM nn WHERE id <> neighbor)"""


def lof(k: int, near: str) -> str:
    """LOF scores of all vectors against the valid ones: vec_id, label, score; ``near``: nn keeps a row itself, nx leaves it out."""
    return f"""SELECT id AS vec_id, label, avg(l.lrd) / (1 / (avg(greatest(distance, kd)) + 1e-10)) - 1.5 AS score FROM {near} JOIN (SELECT id AS kid, max(distance) AS kd FROM nx WHERE label = 'valid' AND r <= {k} GROUP BY 1) ON kid = neighbor
  JOIN (SELECT id AS lid, 1 / (avg(greatest(distance, kd)) + 1e-10) AS lrd FROM nx JOIN (SELECT id AS kid, max(distance) AS kd FROM nx WHERE label = 'valid' AND r <= {k} GROUP BY 1) ON kid = neighbor WHERE label = 'valid' AND r <= {k} GROUP BY 1) l ON lid = neighbor
  WHERE r <= {k} GROUP BY id, label"""


# ---- F -----------------------------------------------------------------------------------


def fitted(spark, sf_dir, model, digits=4):
    v = vectors(spark, sf_dir)
    return model.fit(runs.normal(v)).score(v).select("vec_id", F.round("score", digits).alias("score"))


NORMAL = "SELECT embedding FROM vec WHERE label = 'valid'"


@query(f"WITH RECURSIVE {VEC}, {gauss('f', NORMAL)} SELECT vec_id, round(d2, 4) AS score FROM ({squared('f', 'FROM vec')})")
def f1_mahalanobis(spark, sf_dir):
    return fitted(spark, sf_dir, D.Mahalanobis())


@query(f"WITH RECURSIVE {VEC}, {gauss('f', NORMAL, 1, 1e-6)} SELECT vec_id, round(sqrt(d2), 4) AS score FROM ({squared('f', 'FROM vec')})")
def f2_mahalanobis_ridge(spark, sf_dir):
    return fitted(spark, sf_dir, D.RidgeMahalanobis())


@query()
def f3_gaussian_mixture(spark, sf_dir):
    return fitted(spark, sf_dir, D.GaussianMixture(k=3, covariance="diag", n_init=2, max_iter=20))


@query()
def f4_isolation_forest(spark, sf_dir):
    return fitted(spark, sf_dir, D.IsolationForest(n_estimators=100, contamination=0.05))


@query(f"WITH {NEAREST} SELECT vec_id, round(score, 4) AS score FROM ({lof(20, 'nn')})")
def f5_local_outlier_factor(spark, sf_dir):
    return fitted(spark, sf_dir, D.LocalOutlierFactor(20))


@query()
def f6_one_class_svm(spark, sf_dir):
    return fitted(spark, sf_dir, D.OneClassSVM(n_features=128, max_iter=12))


@query("SELECT count(*) AS rows, true AS optimal, true AS at_most_nu_outside, true AS at_least_nu_support FROM embeddings")
def f6_kernel_svm(spark, sf_dir):
    """The exact dual, and what its optimum guarantees: no violating pair, nu between the rows outside and the support vectors."""
    v, nu = vectors(spark, sf_dir), 0.1
    model = KernelOneClassSVM(nu=nu, working=400).fit(runs.normal(v))
    scored, p = model.score(v), model.params
    out = F.count_if((F.col("label") == "valid") & (F.col("score") > 2 * p["gap"] + 1e-9))
    n = F.count_if(F.col("label") == "valid")
    return scored.agg(F.count("score").alias("rows"), F.lit(p["gap"] <= 1e-3).alias("optimal"), (out <= nu * n + 1e-9).alias("at_most_nu_outside"), (F.lit(len(p["alpha"])) >= nu * n - 1e-9).alias("at_least_nu_support"))


CENTER = f"""WITH {VEC}, dims AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM vec), c AS (SELECT d, avg(CAST(x AS DOUBLE)) AS m FROM dims WHERE label = 'valid' GROUP BY d)"""


@query(f"{CENTER} SELECT vec_id, round(sum((x - m) * (x - m)), 4) AS score FROM dims JOIN c USING (d) GROUP BY vec_id")
def f7_hypersphere(spark, sf_dir):
    return fitted(spark, sf_dir, D.Hypersphere())


@query()
def f10_pca_detector(spark, sf_dir):
    return fitted(spark, sf_dir, D.PcaDetector(D.Mahalanobis(), 16))


@query(f"{CENTER}, s AS (SELECT vec_id, sum((x - m) * (x - m)) AS score FROM dims JOIN c USING (d) GROUP BY vec_id) SELECT count(*) AS rows, round(avg(score), 4) AS mean FROM s")
def a7_model_roundtrip(spark, sf_dir):
    v = vectors(spark, sf_dir)
    path = folder(spark, "a7")
    D.Hypersphere().fit(runs.normal(v)).save(spark, path)
    return D.load(spark, path).score(v).agg(F.count("*").alias("rows"), F.round(F.avg("score"), 4).alias("mean"))


ROUND_TRIP = {
    "gmm": lambda: D.GaussianMixture(k=2, covariance="diag", n_init=1, max_iter=3),
    "isolation_forest": lambda: D.IsolationForest(n_estimators=10, contamination=0.05),
    "lof": lambda: D.LocalOutlierFactor(10),
    "ocsvm": lambda: D.OneClassSVM(n_features=32, max_iter=2),
    "pca": lambda: D.PcaDetector(D.Mahalanobis(), 8),
}


@query(f"WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT unnest({sorted(ROUND_TRIP)}) AS name, n AS rows, n AS same FROM n")
def a7_models_roundtrip(spark, sf_dir):
    """Every kind of model gives the scores it had after it was written and read."""
    v, out = vectors(spark, sf_dir), []
    for name, make in ROUND_TRIP.items():
        path, model = folder(spark, f"a7-{name}"), make().fit(runs.normal(v))
        model.save(spark, path)
        before = model.score(v).select("vec_id", F.col("score").alias("a"))
        after = D.load(spark, path).score(v).select("vec_id", F.col("score").alias("b"))
        both = before.join(after, "vec_id").agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("a") - F.col("b")) <= 1e-9).alias("same"))
        out.append(both.select(F.lit(name).alias("name"), "rows", "same"))
    return runs._stack(out)


@query(f"""WITH {TERMS}, e AS (SELECT doc_id FROM documents WHERE lang = 'en'), v AS (SELECT term, count(*) AS df FROM terms SEMI JOIN e USING (doc_id) GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 150),
w AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM e)) / (1 + df)) + 1) AS w FROM terms JOIN v USING (term)), n AS (SELECT doc_id, count(*) AS c, max(w) / sqrt(sum(w * w)) AS top FROM w GROUP BY 1)
SELECT doc_id, 150 AS dims, coalesce(c, 0) AS nonzero, round(coalesce(top, 0), 5) AS top FROM documents LEFT JOIN n USING (doc_id)""")
def k3_tfidf_encoder(spark, sf_dir):
    """The registered encoder, fitted on English texts, saved, loaded and applied to all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = folder(spark, "k3")
    registry.ENCODERS.get("TFIDF")(max_features=150).fit(docs.where("lang = 'en'")).save(spark, path)
    got = encoders.load(spark, path).encode(docs)
    return got.select(
        "doc_id", F.size("embedding").alias("dims"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"), F.round(F.array_max("embedding"), 5).alias("top")
    )


@query(f"{FLAGS} SELECT g.request_id, count(*) FILTER (flag = 'ANGLE') AS angle, count(*) FILTER (flag = 'WSPAD') AS wspad FROM good g LEFT JOIN flg f USING (request_id) GROUP BY 1")
def k3_flag_encoder(spark, sf_dir):
    got = registry.ENCODERS.get("flags")(["ANGLE", "WSPAD"]).encode(normalized(spark, sf_dir).select("request_id", "all_flags"))
    e = F.col("embedding")
    return got.select("request_id", e[0].cast("long").alias("angle"), e[1].cast("long").alias("wspad"))


@query(f"{CENTER}, s AS (SELECT vec_id, sum((x - m) * (x - m)) AS score FROM dims JOIN c USING (d) GROUP BY vec_id) SELECT 'hypersphere' AS detector, vec_id, round(score, 4) AS score FROM s")
def k_registries(spark, sf_dir):
    """A reader and a detector by name: embeddings are written, read, fitted and scored."""
    path = folder(spark, "k2")
    R.write_embeddings(vectors(spark, sf_dir), path, "none", "table")
    read, _ = registry.READERS.get("Embeddings")(spark, path)
    model = registry.MODELS.get("HyperSphere")().fit(runs.normal(read))
    return model.score(read).select(F.lit(model.name).alias("detector"), "vec_id", F.round("score", 4).alias("score"))


# ---- S -----------------------------------------------------------------------------------


def event_stream(spark, sf_dir):
    """Requests from the events file as a file source in event time."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    raw.select("event_id", "ts", "event_type", "user_id", "props").repartition("event_id", "ts", "user_id", "props").createOrReplaceTempView("events_stream")
    return spark.sql(REQUESTS_SQL.replace("FROM events", "FROM events_stream"))


def written(stream, spark, name, **options):
    """Run a stream over what is there into Parquet in the shared folder and read it."""
    path = folder(spark, name)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"{FLAGS} SELECT g.label, count(*) AS n, sum(f.c) AS n_flags FROM good g LEFT JOIN (SELECT request_id, count(*) AS c FROM flg GROUP BY 1) f USING (request_id) GROUP BY 1")
def s1_stream_normalize(spark, sf_dir):
    out = streams.stream_normalize(event_stream(spark, sf_dir)).select("label", "error", F.size("all_flags").alias("n"))
    return written(out, spark, "s1").where("error IS NULL").groupBy("label").agg(F.count("*").alias("n"), F.sum("n").alias("n_flags"))


@query("""SELECT coalesce(label, 'rejected') AS kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' THEN 'attack' ELSE 'valid' END AS label FROM events) GROUP BY 1""")
def s1_stream_requests(spark, sf_dir):
    """JSON lines as a stream, good rows and rejected lines apart; every 50th line is cut short."""
    path = folder(spark, "s1-lines")
    line = F.when(F.col("request_id") % 50 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    requests(spark, sf_dir).withColumn("line", F.to_json(F.struct(F.col("request_id").cast("string").alias("id"), "request", "label"))).select(line.alias("value")).write.text(path)
    good, bad = streams.stream_requests(spark, path)
    kinds = written(good.select(F.col("label").alias("kind")), spark, "s1-good").unionByName(written(bad.select(F.lit("rejected").alias("kind")), spark, "s1-bad"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{CENTER}, s AS (SELECT vec_id, sum((x - m) * (x - m)) AS score FROM dims JOIN c USING (d) GROUP BY vec_id) SELECT score > 1.0 AS prediction, count(*) AS n FROM s GROUP BY 1")
def s2_stream_score(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    model = D.Hypersphere().fit(runs.normal(vectors(spark, sf_dir)))
    stream = spark.readStream.schema(v.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/embeddings*")
    out = streams.stream_score(stream.select("vec_id", "embedding"), model, 1.0).select("vec_id", "prediction")
    return written(out, spark, "s2").groupBy("prediction").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, round(avg(length(request)), 6) AS len_mean FROM ({REQUESTS_SQL})")
def s3_stream_batch_metrics(spark, sf_dir):
    path = folder(spark, "s3")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    streams.stream_batch_metrics(event_stream(spark, sf_dir), keep, f"{path}-state").awaitTermination()
    got = spark.read.schema("n long, len_mean double, len_std double, batch int").parquet(path)
    return got.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("len_mean")) / F.sum("n"), 6).alias("len_mean"))


@query(f"{FLAGS} SELECT time_bucket(INTERVAL 10 MINUTES, CAST(ts AS TIMESTAMP)) AS window_start, {_FAMILY} AS family, count(*) AS n_flags FROM flg JOIN good USING (request_id) GROUP BY ALL")
def s4_flag_rate_monitor(spark, sf_dir):
    """Malformed requests are left out, as they are in the flag statistics."""
    stream = streams.stream_normalize(event_stream(spark, sf_dir)).where("error IS NULL")
    return streams.run_complete(streams.flag_rate_monitor(stream), folder(spark, "s4"))


@query(f"{FLAGS} SELECT time_bucket(INTERVAL 10 MINUTES, CAST(ts AS TIMESTAMP)) AS window_start, {_FAMILY} AS family, count(*) AS n_flags FROM flg JOIN good USING (request_id) GROUP BY ALL")
def s4_flag_rate_job(spark, sf_dir):
    """The job with bounded state: what it counted in time and late makes up the whole."""
    path = folder(spark, "s4-job")
    streams.flag_rate_job(streams.stream_normalize(event_stream(spark, sf_dir)).where("error IS NULL"), path).awaitTermination()
    return streams.flag_rates(spark, path).select("window_start", "family", (F.col("n_flags") + F.col("n_late")).alias("n_flags"))


@query("""SELECT count(*) AS n, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std, count(*) AS observed, true AS timed
FROM (SELECT sqrt(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings)""")
def s3_stream_observed(spark, sf_dir):
    """Norms of a stream of vectors (a quarter of their dimensions, as whole ones have norm 1) by batch, put together; rows and latency as the stream's listener saw them."""
    schema, path, log = table(spark, sf_dir, "embeddings").schema, folder(spark, "s3-norms"), streams.BatchLog()
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/embeddings*")
    stream = stream.select(F.col("vec_id").cast("string").alias("request"), F.slice("embedding", 1, 16).alias("embedding"))

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    spark.streams.addListener(log)
    try:
        streams.stream_batch_metrics(stream, keep, f"{path}-state").awaitTermination()
        seen = log.totals()
    finally:
        spark.streams.removeListener(log)
    got = spark.read.schema("n long, len_mean double, len_std double, norm_mean double, norm_std double, batch int").parquet(path)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("norm_mean")) / F.sum("n")
    square = F.sum(F.col("n") * (F.col("norm_std") * F.col("norm_std") + F.col("norm_mean") * F.col("norm_mean"))) / n
    timed = seen["latency_max_ms"] >= (seen["latency_mean_ms"] or 0) > 0
    return got.agg(n.alias("n"), F.round(mean, 6).alias("norm_mean"), F.round(F.sqrt(square - mean * mean), 6).alias("norm_std"), F.lit(seen["rows"]).cast("long").alias("observed"), F.lit(timed).alias("timed"))


# ---- R -----------------------------------------------------------------------------------


@query()
def r1_tfidf_pca_detector_run(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "valid").otherwise("attack").alias("label"))
    return rounded(runs.pca_detector_run(runs.text_vectors(d, 150), 20))


@query()
def r1_normalization_effect(spark, sf_dir):
    return rounded(runs.normalization_effect(streams.stream_normalize(requests(spark, sf_dir)), 60, 10))


@query()
def r2_pca_sweep(spark, sf_dir):
    return rounded(runs.pca_sweep(vectors(spark, sf_dir), [4, 16, 32]))


@query()
def r2_text_pca_sweep(spark, sf_dir):
    """50 to 200 components of 10,000 terms and word pairs."""
    return rounded(runs.text_pca_sweep(labelled_texts(spark, sf_dir), 10_000, [50, 100, 200], n=2))


@query()
def r2_pca_lof_sweep(spark, sf_dir):
    return rounded(runs.pca_sweep(vectors(spark, sf_dir), [4, 16], lambda: D.LocalOutlierFactor(20)))


@query()
def r3_iforest_grid(spark, sf_dir):
    return rounded(runs.grid_run(vectors(spark, sf_dir), D.IsolationForest, {"n_estimators": [20, 50], "max_samples": [64, 128]}))


@query()
def r3_iforest_search(spark, sf_dir):
    """96 configurations: six contaminations, four sizes of forest, four of samples."""
    return rounded(runs.grids.forest_search(vectors(spark, sf_dir), [100, 200, 300, 500], [None, 256, 512, 1024], [0.05, 0.1, 0.15, 0.2, 0.25, 0.3]))


def tuned(spark, sf_dir, cls, grid, **fixed):
    """Size of the frontier, and the best configuration with the metrics of its new fit."""
    got = runs.tuned_run(vectors(spark, sf_dir), cls, grid, **fixed)
    n = got["frontier"].agg(F.count("*").alias("frontier"))
    return rounded(got["refit"].crossJoin(F.broadcast(n)))  # one row each


@query()
def r3_iforest_tuned(spark, sf_dir):
    return tuned(spark, sf_dir, D.IsolationForest, {"n_estimators": [20, 50], "max_samples": [64, 128]})


@query()
def r4_ocsvm_grid(spark, sf_dir):
    return rounded(runs.grid_run(vectors(spark, sf_dir), D.OneClassSVM, {"nu": [0.05, 0.2], "gamma": [0.5, 2.0]}, n_features=64, max_iter=5))


@query()
def r4_ocsvm_search(spark, sf_dir):
    """42 configurations of nu and gamma."""
    grid = {"nu": [0.01, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2], "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0]}
    return rounded(runs.grid_run(vectors(spark, sf_dir), D.OneClassSVM, grid, n_features=128, max_iter=12))


@query()
def r4_ocsvm_tuned(spark, sf_dir):
    return tuned(spark, sf_dir, D.OneClassSVM, {"nu": [0.05], "gamma": [0.5, 2.0]}, n_features=64, max_iter=5)


@query(f"WITH {NEAREST} " + " UNION ALL ".join(at_fpr(lof(k, "nx"), f", {k} AS k") for k in (5, 10, 20)))
def r5_lof_sweep(spark, sf_dir):
    return rounded(runs.lof_sweep(vectors(spark, sf_dir), [5, 10, 20]))


@query()
def r6_gmm_sweep(spark, sf_dir):
    return rounded(runs.grid_run(vectors(spark, sf_dir), D.GaussianMixture, {"k": [1, 2, 3]}, covariance="diag", n_init=1, max_iter=10))


@query()
def r6_gmm_components(spark, sf_dir):
    """One to ten components with AIC and BIC, best of five starts each."""
    return rounded(runs.grid_run(vectors(spark, sf_dir), D.GaussianMixture, {"k": list(range(1, 11))}, covariance="diag", n_init=5, max_iter=30))


def mi_sweep_sql(ks: tuple[int, ...]) -> str:
    parts, out = [], []
    for k in ks:
        dims = f"list_transform((SELECT list(dim ORDER BY mi DESC, dim)[:{k}] FROM mi), lambda i: embedding[i + 1])"
        parts += [f"k{k}_h AS (SELECT * REPLACE ({dims} AS embedding) FROM vec)", gauss(f"k{k}", f"SELECT embedding FROM k{k}_h WHERE label = 'valid'")]
        parts.append(f"k{k}_s AS (SELECT * EXCLUDE (score), d2 AS score FROM ({squared(f'k{k}', f'FROM k{k}_h')}))")
        out.append(at_fpr(f"FROM k{k}_s", f", {k} AS k"))
    return f"WITH RECURSIVE {VEC}, mi AS ({mi_sql('FROM vec')}), {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(mi_sweep_sql((8, 32)))
def r7_mi_k_sweep(spark, sf_dir):
    return rounded(runs.mi_sweep(vectors(spark, sf_dir), [8, 32]))


@query()
def r7_token_mi_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "valid").otherwise("attack").alias("label"))
    return rounded(runs.token_mi_sweep(d, [8, 24], lambda: D.OneClassSVM(n_features=64, max_iter=5)))


def cross_sql(dims: str | None = None) -> str:
    """Fits on the valid rows of one half of the ids, metrics on the other, both ways; ``dims`` picks columns by the fitted half."""
    parts, out = [], []
    for name, fit, test in (("a_to_b", 0, 1), ("b_to_a", 1, 0)):
        half = f"SELECT * REPLACE ({dims.format(half=fit) if dims else 'embedding'} AS embedding) FROM vec"
        parts += [f"{name}_h AS ({half})", gauss(name, f"SELECT embedding FROM {name}_h WHERE label = 'valid' AND vec_id % 2 = {fit}")]
        parts.append(f"{name}_s AS (SELECT * EXCLUDE (score), d2 AS score FROM ({squared(name, f'SELECT * FROM {name}_h WHERE vec_id % 2 = {test}')}))")
        out.append(at_fpr(f"FROM {name}_s", f", '{name}' AS direction"))
    return f"WITH RECURSIVE {VEC}, {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(cross_sql())
def r8_cross_dataset_run(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(runs.cross_dataset_run(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), D.Mahalanobis))


BEST = "list_transform((SELECT list(dim ORDER BY mi DESC, dim)[:12] FROM (" + mi_sql("FROM vec WHERE vec_id % 2 = {half}") + ")), lambda i: embedding[i + 1])"


@query(cross_sql(BEST))
def r8_cross_dataset_selected(spark, sf_dir):
    """The best dimensions of one half carried to the other."""
    v = vectors(spark, sf_dir)
    return rounded(runs.cross_dataset_run(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), D.Mahalanobis, k=12))


@query(f"""WITH {VEC}, j AS (SELECT label, embedding[1] > 0 AS m0, embedding[2] > 0 AS m1, embedding[3] > 0 AS m2 FROM vec)
SELECT round(100 * avg(CAST(m0 = m1 AS INT)), 4) AS agree01, count(*) FILTER (label = 'attack' AND m0 AND m1 AND m2) AS caught_by_all, count(*) FILTER (label = 'attack' AND NOT m0 AND NOT m1 AND NOT m2) AS missed_by_all FROM j""")
def r9_compare_models(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("vec_id", "request_id")
    got = runs.compare_models({f"m{i}": v.select("request_id", "label", (F.col("embedding")[i] > 0).alias("prediction")) for i in range(3)})
    a = got["agreement"].where("model_a = 'm0' AND model_b = 'm1'").select(F.round("agreement", 4).alias("agree01"))
    o = got["overlap"]
    n = o.agg(
        F.coalesce(F.sum(F.when((F.col("kind") == "tp") & (F.col("n_models") == 3), F.col("n"))), F.lit(0)).alias("caught_by_all"),
        F.coalesce(F.sum(F.when((F.col("kind") == "fn") & (F.col("n_models") == 3), F.col("n"))), F.lit(0)).alias("missed_by_all"),
    )
    return a.crossJoin(F.broadcast(n))  # one row each


@query(f"""WITH RECURSIVE {VEC}, tr AS (SELECT vec_id, embedding FROM vec WHERE label = 'valid' ORDER BY md5(concat(vec_id, ':42')), vec_id LIMIT 300), {gauss("f", "FROM tr", 0, 0.0)},
s AS (SELECT * EXCLUDE (score), d2 AS score, vec_id IN (SELECT vec_id FROM tr) AS fitted FROM ({squared("f", "FROM vec")})), t AS (SELECT quantile_cont(score, 0.95) AS threshold FROM s WHERE fitted)
SELECT tp, fp, tn, fn, {METRIC_SQL}, round(threshold, 6) AS threshold FROM (SELECT threshold, count(*) FILTER (score > threshold AND label = 'attack') AS tp, count(*) FILTER (score > threshold AND label = 'valid') AS fp,
  count(*) FILTER (score <= threshold AND label = 'valid') AS tn, count(*) FILTER (score <= threshold AND label = 'attack') AS fn FROM s, t WHERE NOT fitted GROUP BY threshold)""")
def r10_train_test_report(spark, sf_dir):
    return rounded(runs.train_test_report(vectors(spark, sf_dir), D.Mahalanobis(), 300)["metrics"])


