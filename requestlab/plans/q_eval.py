"""Registered queries: joins, metrics, sampling, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from requestlab.operators import features, joins, metrics, sampling

from .q_requests import FLAGS, long_flags, normalized
from .tables import REQUESTS_SQL, requests, table, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VEC = "vec AS (SELECT vec_id, CASE WHEN label = 9 THEN 'attack' ELSE 'valid' END AS label, embedding, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings)"
#: Runs of a made-up sweep, derived from the tables: one a source and type of event.
RUNS = """runs AS (SELECT concat(event_type, '-', user_id % 40) AS run_id, event_type AS kind, user_id % 40 AS k,
  round(CAST(sum(event_id % 7) AS DOUBLE) / (6 * count(*)), 6) AS recall, round(CAST(sum(event_id % 11) AS DOUBLE) / (100 * count(*)), 6) AS fpr FROM events GROUP BY 1, 2, 3)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def scores(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("score", F.col("embedding")[0].cast("double"))


def judged(spark, sf_dir):
    """Classifier outputs: toxic is the attack, low quality the prediction."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("request_id"), F.when(F.col("toxic") == 1, "attack").otherwise("valid").alias("label"), (F.col("quality") == 0).alias("prediction")
    )


def runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 40
    return e.groupBy(F.concat("event_type", F.lit("-"), k.cast("string")).alias("run_id"), F.col("event_type").alias("kind"), k.alias("k")).agg(
        r6(F.sum(F.col("event_id") % 7).cast("double") / (6 * F.count("*"))).alias("recall"),
        r6(F.sum(F.col("event_id") % 11).cast("double") / (100 * F.count("*"))).alias("fpr"),
    )


def three_models(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("vec_id", "request_id")
    return joins.join_predictions({f"m{i}": v.select("request_id", "label", (F.col("embedding")[i] > 0).alias("prediction")) for i in range(3)})


MODELS = ["m0", "m1", "m2"]
JOINED = f"{VEC}, j AS (SELECT vec_id AS request_id, label, embedding[1] > 0 AS m0, embedding[2] > 0 AS m1, embedding[3] > 0 AS m2 FROM vec)"


# ---- C -----------------------------------------------------------------------------------


@query(f"WITH req AS ({REQUESTS_SQL}) SELECT vec_id, r.label, length(r.request) AS chars FROM embeddings e JOIN req r ON r.request_id = e.vec_id")
def c1_attach_metadata(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request_id"), "embedding")
    return joins.attach_metadata(v, requests(spark, sf_dir)).select(F.col("request_id").alias("vec_id"), "label", F.length("request").alias("chars"))


@query(f"""WITH {VEC}, d AS (SELECT t.vec_id AS id, n.vec_id AS neighbor, sqrt(list_sum(list_transform(list_zip(t.embedding, n.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))) AS distance
  FROM vec t, vec n WHERE t.label = 'attack' AND n.label = 'valid')
SELECT id, rank, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d) WHERE rank <= 3""")
def c2_nearest_neighbor(spark, sf_dir):
    v = vectors(spark, sf_dir)
    got = joins.nearest_neighbors(v.where("label = 'attack'"), v.where("label = 'valid'"), 3)
    return got.select("id", F.col("rank").cast("long").alias("rank"), F.round("distance", 4).alias("distance"))


@query(f"WITH {JOINED} SELECT label, m0, m1, m2, count(*) AS n FROM j GROUP BY ALL")
def c3_join_predictions(spark, sf_dir):
    return three_models(spark, sf_dir).groupBy("label", *MODELS).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS nation, c AS contamination, t AS trees FROM nation, (SELECT unnest([0.01, 0.05, 0.1]) AS c), (SELECT unnest([100, 200]) AS t)")
def c4_param_grid(spark, sf_dir):
    grid = joins.param_grid(spark, contamination=[0.01, 0.05, 0.1], trees=[100, 200])
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).crossJoin(F.broadcast(grid))  # six rows


@query(f"""WITH {RUNS}, f AS (SELECT * FROM runs WHERE fpr <= 0.05) SELECT run_id, recall, fpr FROM f c WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.recall > c.recall AND o.fpr < c.fpr)""")
def c5_pareto_frontier(spark, sf_dir):
    return joins.pareto_frontier(runs(spark, sf_dir), 0.05).select("run_id", "recall", "fpr")


#: What (?U)\\w takes: letters, marks, digits, letter numbers and connectors.
TERM = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}"
TERMS = f"""terms AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM documents) GROUP BY ALL)"""


def terms(spark, sf_dir):
    return features.term_counts(table(spark, sf_dir, "documents"), "doc_id", features.tokenize(F.col("text")))


@query(f"""WITH {TERMS}, top AS (SELECT term FROM terms GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 50) SELECT term, count(*) AS docs, sum(tf) AS tf FROM terms WHERE term IN (FROM top) GROUP BY term""")
def c6_project_vocabulary(spark, sf_dir):
    t = terms(spark, sf_dir)
    top = t.groupBy("term").agg(F.sum("tf").alias("tf")).orderBy(F.desc("tf"), "term").limit(50)
    return joins.project_vocabulary(t, top).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


# ---- D -----------------------------------------------------------------------------------

CONF = """conf AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 0 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 0 AND toxic = 1) AS fn FROM labels)"""
METRIC_SQL = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(fp / greatest(fp + tn, 1), 6) AS fpr, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity"""


@query(f"WITH {CONF} SELECT * FROM conf")
def d1_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(judged(spark, sf_dir))


def rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {CONF} SELECT tp, fp, tn, fn, {METRIC_SQL} FROM conf")
def d2_classification_metrics(spark, sf_dir):
    return rounded(metrics.classification_metrics(metrics.confusion_matrix(judged(spark, sf_dir))))


@query(f"""WITH {VEC}, c AS (SELECT quantile_cont(score, 0.95) AS threshold FROM vec WHERE label = 'valid'),
m AS (SELECT threshold, count(*) FILTER (score > threshold AND label = 'attack') AS tp, count(*) FILTER (score > threshold AND label = 'valid') AS fp,
  count(*) FILTER (score <= threshold AND label = 'valid') AS tn, count(*) FILTER (score <= threshold AND label = 'attack') AS fn FROM vec, c GROUP BY threshold)
SELECT tp, fp, tn, fn, {METRIC_SQL}, round(threshold, 6) AS threshold FROM m""")
def d3_metrics_at_fpr(spark, sf_dir):
    return rounded(metrics.metrics_at_fpr(scores(spark, sf_dir)))


@query(f"WITH req AS ({REQUESTS_SQL}) SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM req), 6) AS ratio FROM req GROUP BY label")
def d4_label_counts(spark, sf_dir):
    return rounded(metrics.label_counts(requests(spark, sf_dir)))


STATS = f"""{FLAGS}, nreq AS (SELECT label, count(*) AS n FROM good GROUP BY label),
st AS (SELECT label, flag, count(*) AS total, count(DISTINCT request_id) AS n_with FROM flg GROUP BY label, flag)"""


def flag_table(spark, sf_dir, k):
    return metrics.flag_stats(normalized(spark, sf_dir).select("label", "all_flags"), k)


@query(f"""{STATS} SELECT label, rank, flag, total, round(total / n, 6) AS per_request, round(n_with / n, 6) AS presence_rate FROM
(SELECT st.*, n, row_number() OVER (PARTITION BY st.label ORDER BY total DESC, flag) AS rank FROM st JOIN nreq USING (label)) WHERE rank <= 25""")
def d5_flag_stats(spark, sf_dir):
    return rounded(flag_table(spark, sf_dir, 25)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{FLAGS}, per AS (SELECT g.request_id, any_value(g.label) AS label, count(f.flag) AS v FROM good g LEFT JOIN flg f USING (request_id) GROUP BY 1),
rk AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) AS r, count(*) OVER (PARTITION BY label) AS n FROM per)
SELECT label, round(avg(v), 6) AS mean, round(avg(v) FILTER (r IN ((n + 1) // 2, (n + 2) // 2)), 6) AS median, max(v) FILTER (r = ceil(n * 90 / 100)) AS p90, max(v) FILTER (r = ceil(n * 95 / 100)) AS p95,
  max(v) FILTER (r = ceil(n * 99 / 100)) AS p99, min(v) AS min, max(v) AS max FROM rk GROUP BY label""")
def d6_nearest_rank_summary(spark, sf_dir):
    n = normalized(spark, sf_dir).select("label", F.size("all_flags").alias("v0"))
    return rounded(metrics.nearest_rank_summary(n, "v0", "label"))


@query(f"""WITH {VEC} SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max,
{", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))},
CASE WHEN var_pop(score) < 0.001 THEN 'very low' WHEN var_pop(score) < 0.01 THEN 'low' ELSE 'ok' END AS variance_verdict FROM vec GROUP BY label""")
def d7_score_stats(spark, sf_dir):
    return rounded(metrics.score_stats(scores(spark, sf_dir), ["label"]))


@query(f"""WITH {VEC}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM vec), b AS (SELECT label, least(49, CAST(floor((score - lo) / ((hi - lo) / 50)) AS INT)) AS bin, lo, hi FROM vec, e)
SELECT label, bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 50, 6) AS "left", count(*) AS n FROM b GROUP BY label, bin""")
def d8_score_histogram(spark, sf_dir):
    return rounded(metrics.score_histogram(scores(spark, sf_dir)).drop("density"))


@query(f"WITH {VEC} SELECT c AS contamination, round(quantile_cont(score, 1 - c), 6) AS threshold FROM (SELECT score, unnest([0.5, 0.25, 0.125]) AS c FROM vec) GROUP BY c".replace("quantile_cont(score, 1 - c)", "CASE c WHEN 0.5 THEN quantile_cont(score, 0.5) WHEN 0.25 THEN quantile_cont(score, 0.75) ELSE quantile_cont(score, 0.875) END"))
def d9_contamination_thresholds(spark, sf_dir):
    return rounded(metrics.contamination_thresholds(scores(spark, sf_dir), (0.5, 0.25, 0.125)))


@query(f"""WITH {JOINED}, l AS (SELECT request_id, unnest(['m0', 'm1', 'm2']) AS model, unnest([m0, m1, m2]) AS p FROM j)
SELECT a.model AS model_a, b.model AS model_b, round(avg(CAST(a.p = b.p AS INT)) * 100, 6) AS agreement FROM l a JOIN l b USING (request_id) GROUP BY ALL""")
def d10_agreement_matrix(spark, sf_dir):
    return rounded(metrics.agreement_matrix(three_models(spark, sf_dir), MODELS))


HITS = "CAST(m0 AS INT) + CAST(m1 AS INT) + CAST(m2 AS INT)"


@query(f"""WITH {JOINED} SELECT kind, n_models, count(*) AS n FROM (SELECT 'fp' AS kind, {HITS} AS n_models FROM j WHERE label = 'valid'
UNION ALL SELECT 'fn', 3 - ({HITS}) FROM j WHERE label = 'attack' UNION ALL SELECT 'tp', {HITS} FROM j WHERE label = 'attack') GROUP BY ALL""")
def d11_error_overlap(spark, sf_dir):
    return metrics.error_overlap(three_models(spark, sf_dir), MODELS)


@query(f"WITH {JOINED} SELECT CASE WHEN m0 THEN 'm0' WHEN m1 THEN 'm1' ELSE 'm2' END AS model, count(*) AS n FROM j WHERE label = 'attack' AND {HITS} = 1 GROUP BY 1")
def d11_unique_catches(spark, sf_dir):
    return metrics.unique_catches(three_models(spark, sf_dir), MODELS)


@query(f"""WITH {JOINED} SELECT CASE label WHEN 'attack' THEN 'fn' ELSE 'fp' END AS kind, CAST(m0 <> (label = 'attack') AS INT) + 2 * CAST(m1 <> (label = 'attack') AS INT) + 4 * CAST(m2 <> (label = 'attack') AS INT) AS region, count(*) AS n
FROM j GROUP BY ALL HAVING region > 0""")
def d12_error_venn(spark, sf_dir):
    return metrics.error_venn(three_models(spark, sf_dir), MODELS)


BATCHES = f"""req AS ({REQUESTS_SQL}), b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch, length(request) AS len, nrm, ts FROM
  (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm FROM embeddings) e JOIN req r ON r.request_id = e.vec_id)"""


def batches(spark, sf_dir):
    """Vectors beside their requests, with an event's time for the start and the end."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request_id"), "embedding")
    return metrics.batch_metrics(joins.attach_metadata(v, requests(spark, sf_dir)), 64, start="ts", end="ts")


@query(f"""WITH {BATCHES}, g AS (SELECT batch, count(*) AS n, round(avg(len), 6) AS len_mean, round(stddev_pop(len), 6) AS len_std, round(avg(nrm), 4) AS norm_mean, round(stddev_pop(nrm), 4) AS norm_std,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000, 3) AS latency_ms FROM b GROUP BY 1) SELECT *, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS seen FROM g""")
def d13_batch_metrics(spark, sf_dir):
    return rounded(batches(spark, sf_dir)).withColumns({"norm_mean": F.round("norm_mean", 4), "norm_std": F.round("norm_std", 4), "latency_ms": F.round("latency_ms", 3)})


@query(f"""WITH {BATCHES}, g AS (SELECT batch, count(*) AS n, sum(len) AS len, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000 AS ms FROM b GROUP BY 1)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS rows, round(sum(len) / sum(n), 6) AS len_mean, round(avg(ms), 3) AS latency_mean_ms, round(max(ms), 3) AS latency_max_ms FROM g""")
def d13_run_totals(spark, sf_dir):
    got = rounded(metrics.run_totals(batches(spark, sf_dir)))
    return got.withColumns({c: F.round(c, 3) for c in ("latency_mean_ms", "latency_max_ms")})


@query(f"""WITH {VEC}, m AS (SELECT label, round(avg(score * score), 6) AS mean, round(median(score * score), 6) AS median, round(stddev_pop(score * score), 6) AS std, round(min(score * score), 6) AS min, round(max(score * score), 6) AS max, avg(score * score) AS raw FROM vec GROUP BY label)
SELECT label, mean, median, std, min, max, round((SELECT raw FROM m WHERE label = 'attack') / (SELECT raw FROM m WHERE label = 'valid'), 6) AS attack_ratio FROM m""")
def d14_nn_distance_summary(spark, sf_dir):
    return rounded(metrics.distance_summary(scores(spark, sf_dir).withColumn("distance", F.col("score") * F.col("score"))))


@query(r"""WITH t AS (SELECT regexp_extract_all(text, '[^\s]+') AS t FROM documents) SELECT count(*) AS documents, round(avg(len(t)), 6) AS mean_tokens, min(len(t)) AS min_tokens, max(len(t)) AS max_tokens,
round(avg(CAST(len(t) >= 512 AS INT)), 6) AS long_share, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM t)) AS vocabulary FROM t""")
def d15_corpus_stats(spark, sf_dir):
    return rounded(metrics.corpus_stats(table(spark, sf_dir, "documents"), features.tokenize(F.col("text"), "space")))


KINDS = ["click", "view", "purchase", "error", "signup"]


def one_hot(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "event_type")
    return e.select("request_id", *[((F.col("event_type") == k) | (F.col("request_id") % 17 == i)).cast("int").alias(k) for i, k in enumerate(KINDS)])


HOT = "hot AS (SELECT event_id AS request_id, " + ", ".join(f"CAST(event_type = '{k}' OR event_id % 17 = {i} AS INT) AS {k}" for i, k in enumerate(KINDS)) + " FROM events)"


@query(f"WITH {HOT} " + " UNION ALL ".join(f"SELECT '{k}' AS category, sum({k}) AS n FROM hot" for k in KINDS))
def d16_category_counts(spark, sf_dir):
    return metrics.category_counts(one_hot(spark, sf_dir), KINDS)


@query(f"WITH {RUNS}, b AS (SELECT recall AS base FROM runs WHERE run_id = 'error-0') SELECT run_id, round((recall - base) * 100, 4) AS points, round(recall / base - 1, 4) AS relative FROM runs, b")
def d17_compare_runs(spark, sf_dir):
    got = metrics.compare_runs(runs(spark, sf_dir), "recall", F.col("run_id") == "error-0")
    return got.select("run_id", F.round("points", 4).alias("points"), F.round("relative", 4).alias("relative"))


@query(f"""{STATS} SELECT flag, round((coalesce(max(n_with / n) FILTER (st.label = 'attack'), 0) - coalesce(max(n_with / n) FILTER (st.label = 'valid'), 0)) * 100, 4) AS lift FROM st JOIN nreq USING (label) GROUP BY flag""")
def d18_flag_lift(spark, sf_dir):
    return metrics.flag_lift(flag_table(spark, sf_dir, 10_000)).select("flag", F.round("lift", 4).alias("lift"))


@query(f"WITH {RUNS} SELECT kind AS level, round(avg(recall), 6) AS mean, round(stddev_pop(recall), 6) AS std FROM runs GROUP BY 1")
def d19_sweep_marginals(spark, sf_dir):
    return rounded(metrics.sweep_marginals(runs(spark, sf_dir), "kind", "recall"))


@query(f"WITH {RUNS} SELECT a.k, a.recall AS recall_a, a.fpr AS fpr_a, b.recall AS recall_b, b.fpr AS fpr_b FROM runs a JOIN runs b ON a.k = b.k AND a.kind = 'click' AND b.kind = 'view'")
def d20_compare_sweeps(spark, sf_dir):
    r = runs(spark, sf_dir)
    return metrics.compare_sweeps(r.where("kind = 'click'"), r.where("kind = 'view'"))


# ---- F8, F9, F11, F12: thresholds ---------------------------------------------------------


@query(f"WITH {VEC}, c AS (SELECT quantile_cont(score, 0.95) AS t FROM vec WHERE label = 'valid') SELECT round(any_value(t), 6) AS threshold, round(avg(CAST(score > t AS INT)), 6) AS actual_fpr FROM vec, c WHERE label = 'valid'")
def f8_set_threshold(spark, sf_dir):
    return rounded(metrics.threshold_at_fpr(scores(spark, sf_dir)))


@query(f"WITH {VEC} SELECT vec_id, score > 0.1 AS prediction FROM vec")
def f9_predict(spark, sf_dir):
    return metrics.predict(scores(spark, sf_dir), 0.1).select("vec_id", "prediction")


@query(f"WITH {JOINED} SELECT count(*) FILTER ((m0 OR m1) AND label = 'attack') AS tp, count(*) FILTER ((m0 OR m1) AND label = 'valid') AS fp, count(*) FILTER (NOT (m0 OR m1) AND label = 'valid') AS tn, count(*) FILTER (NOT (m0 OR m1) AND label = 'attack') AS fn FROM j")
def f11_ensemble_any(spark, sf_dir):
    from requestlab.operators.detectors import ensemble_any

    return metrics.confusion_matrix(ensemble_any(three_models(spark, sf_dir), MODELS[:2]))


@query(f"WITH {VEC}, g AS (SELECT *, vec_id % 5 AS endpoint FROM vec), c AS (SELECT endpoint, quantile_cont(score, 0.95) AS t FROM g WHERE label = 'valid' GROUP BY 1) SELECT endpoint, round(t, 6) AS threshold, count(*) FILTER (score > t) AS flagged FROM g JOIN c USING (endpoint) GROUP BY ALL")
def f12_threshold_per_group(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("endpoint", F.col("vec_id") % 5)
    cut = metrics.threshold_at_fpr(s, by=["endpoint"])
    got = metrics.predict(s, cut, by=["endpoint"]).groupBy("endpoint", r6(F.col("threshold")).alias("threshold"))
    return got.agg(F.count_if("prediction").alias("flagged"))


# ---- G -----------------------------------------------------------------------------------

ORD = "md5(concat(request_id, ':42'))"
LAB = f"lab AS (SELECT request_id, label FROM ({REQUESTS_SQL}))"


def labelled(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", "label")


@query(f"WITH {LAB}, v AS (SELECT request_id FROM lab WHERE label = 'valid' ORDER BY {ORD}, request_id LIMIT 500) SELECT CASE WHEN request_id IN (FROM v) THEN 'train' ELSE 'test' END AS part, request_id, label FROM lab")
def g1_split_one_class(spark, sf_dir):
    a, b = sampling.split_one_class(labelled(spark, sf_dir), 500)
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query(f"WITH {LAB} SELECT request_id, label, population FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORD}, request_id) AS r, count(*) OVER (PARTITION BY label) AS population FROM lab) WHERE r <= 100")
def g2_sample_per_label(spark, sf_dir):
    return sampling.sample_per_label(labelled(spark, sf_dir), 100)


@query(f"""WITH {HOT}, l AS (SELECT request_id, unnest([{", ".join(f"CASE WHEN {k} = 1 THEN '{k}' END" for k in KINDS)}]) AS category FROM hot),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {ORD}, request_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM l WHERE category IS NOT NULL)
SELECT DISTINCT request_id FROM r WHERE r <= greatest(1, floor(n * 0.15))""")
def g3_sample_per_category(spark, sf_dir):
    return sampling.sample_per_category(one_hot(spark, sf_dir), KINDS).select("request_id")


@query(f"WITH {LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORD}, request_id) AS r FROM lab) SELECT request_id, label FROM r WHERE r <= least(200, (SELECT min(c) FROM (SELECT count(*) AS c FROM lab GROUP BY label)))")
def g4_balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(labelled(spark, sf_dir), 400)


@query(f"WITH {LAB} SELECT request_id, CASE WHEN CAST(concat('0x', left({ORD}, 8)) AS BIGINT) < {int(0.9 * (1 << 32))} THEN 'train' ELSE 'validation' END AS part FROM lab")
def g5_random_split(spark, sf_dir):
    return sampling.hash_split(labelled(spark, sf_dir)).select("request_id", "part")


@query(f"SELECT request_id, request, label FROM (SELECT *, row_number() OVER (ORDER BY request_id) AS r FROM ({REQUESTS_SQL})) WHERE r % 100 = 0")
def g6_every_nth(spark, sf_dir):
    return sampling.every_nth(requests(spark, sf_dir), 100).select("request_id", "request", "label")


@query(f"SELECT request_id, label FROM ({REQUESTS_SQL}) ORDER BY request_id LIMIT 100")
def g7_head_n(spark, sf_dir):
    return sampling.head_n(labelled(spark, sf_dir), 100)


# ---- H -----------------------------------------------------------------------------------


@query(f"{FLAGS} SELECT flag, count(*) AS total FROM flg GROUP BY flag ORDER BY total DESC, flag LIMIT 25")
def h1_top_flags(spark, sf_dir):
    return sampling.top_k(long_flags(spark, sf_dir).groupBy("flag").agg(F.count("*").alias("total")), "total", 25, "flag")


@query(f"WITH {TERMS} SELECT term, sum(tf) AS tf FROM terms GROUP BY term ORDER BY tf DESC, term LIMIT 40")
def h2_top_features(spark, sf_dir):
    return sampling.top_k(terms(spark, sf_dir).groupBy("term").agg(F.sum("tf").alias("tf")), "tf", 40, "term")


@query(f"WITH {RUNS} SELECT run_id, recall, fpr FROM runs WHERE fpr <= 0.05 ORDER BY recall DESC, fpr, run_id LIMIT 1")
def h3_best_run(spark, sf_dir):
    return sampling.best_run(runs(spark, sf_dir), 0.05).select("run_id", "recall", "fpr")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS seen, count(*) OVER (PARTITION BY user_id) AS repeats,
(row_number() OVER (ORDER BY event_id) - 1) // 512 AS batch_index FROM events""")
def h4_running_windows(spark, sf_dir):
    got = metrics.running_windows(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 512)
    return got.select("event_id", "seen", "repeats", "batch_index")


@query(f"SELECT CAST(label = 'attack' AS INT) AS target, count(*) AS n FROM ({REQUESTS_SQL}) GROUP BY 1")
def h5_union_classes(spark, sf_dir):
    r = labelled(spark, sf_dir)
    return sampling.union_classes(r.where("label = 'valid'"), r.where("label = 'attack'")).groupBy("target").agg(F.count("*").alias("n"))


@query(f"""WITH {TERMS}, a AS (SELECT DISTINCT term FROM terms WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT term FROM terms WHERE doc_id % 2 = 1)
SELECT side, count(*) AS n FROM (SELECT CASE WHEN b.term IS NULL THEN 'left' WHEN a.term IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b USING (term)) GROUP BY side""")
def h6_token_overlap(spark, sf_dir):
    t = terms(spark, sf_dir)
    return sampling.token_overlap(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1")).groupBy("side").agg(F.count("*").alias("n"))


@query(f"SELECT min(request_id) AS request_id FROM ({REQUESTS_SQL}) GROUP BY request")
def h7_distinct_requests(spark, sf_dir):
    return sampling.distinct_requests(requests(spark, sf_dir)).select("request_id")


@query(f"""{STATS} SELECT label, rank, flag, total FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, flag) AS rank FROM st) WHERE rank <= 10""")
def top_flags(spark, sf_dir):
    return flag_table(spark, sf_dir, 10).select("label", F.col("rank").cast("long").alias("rank"), "flag", "total")
