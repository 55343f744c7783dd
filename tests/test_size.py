"""Work that must not grow faster than the input: what is shuffled, joined and read again."""

import numpy as np
from pyspark.sql import functions as F

from requestlab.operators import detectors as D
from requestlab.operators import encoders, features, joins, neighbors
from requestlab.plans import runs
from requestlab.sources import store

TEXTS = [(0, "a cat saw a cat run", "valid"), (1, "the dog saw the cat", "valid"), (2, None, "valid"), (3, "x", "attack"), (None, "cat lost cat", "valid"), (4, "Dog RUN dog run", "attack")]


def test_vocabulary_without_bounds(spark, monkeypatch):
    """Terms ranked before documents are counted: the same table, with null keys; nothing else counts all terms by document."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, label string")
    table = lambda df: sorted(map(tuple, df.select("term", "df", "tf", "idx").collect()))
    for n, most in ((1, 3), (2, 5), (3, 100)):
        tokens = features.tokenize(F.col("text"), n=n)
        want = features.build_vocabulary(features.term_counts(docs, "doc_id", tokens), 6, 1, 1.0, most)
        assert table(features.top_vocabulary(docs, "doc_id", tokens, most)) == table(want)
    plain, asked = features.term_counts, []
    monkeypatch.setattr(features, "term_counts", lambda *a: asked.append(len(a) == 4) or plain(*a))
    model = encoders.TfidfEncoder("doc_id", 5, n=2).fit(docs)
    model.weights(docs).count()
    assert len(asked) == 2 and all(asked)


def test_grams(spark):
    docs = spark.createDataFrame([("one two three four",), ("one two",), ("one",), ("",), (None,)], "text string")
    for n in (1, 2, 3, 4):
        for r in docs.select("text", features.tokenize(F.col("text"), n=n).alias("t")).collect():
            t = (r["text"] or "").split()
            assert r["t"] == [" ".join(t[i : i + k]) for k in range(1, n + 1) for i in range(len(t) - k + 1)]


def test_texts_are_read_once(spark, monkeypatch):
    """Vectors and scores of a run are written before they are scanned several times."""
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 5} u{i % 3}", "attack" if i % 9 == 0 else "valid") for i in range(90)], "doc_id long, text string, label string")
    made, plain = [], store.materialize
    monkeypatch.setattr(store, "materialize", lambda df, name: made.append(name) or plain(df, name))
    got = runs.pca_detector_run(runs.text_vectors(docs, 10), 3).first()
    assert got["tp"] + got["fp"] + got["tn"] + got["fn"] == 90 and {"vectors", "scores"} <= set(made)


def test_lof_joins_only_new_rows(spark, monkeypatch, tmp_path):
    """Rows of the model take the neighbours of the fit: scores as by a join of all, for copies, moved rows and shared ids too."""
    r = np.random.Generator(np.random.PCG64(3))
    x = r.standard_normal((120, 4)).round(1)
    x[40:60] = x[:20]
    rows = [(i, v.tolist()) for i, v in enumerate(x[:100])] + [(7, x[101].tolist()), (300, None)]
    train = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    test = train.unionByName(spark.createDataFrame([(200, x[105].tolist()), (201, x[3].tolist()), (9, x[106].tolist())], train.schema)).where("vec_id <> 12")
    test = test.unionByName(spark.createDataFrame([(12, x[107].tolist())], train.schema))
    model = D.LocalOutlierFactor(6).fit(train)
    want = model.score(test, max_k=joins.nearest_neighbors(test, model.model, 6))
    joined, plain = [], joins.nearest_neighbors
    monkeypatch.setattr(joins, "nearest_neighbors", lambda a, *b, **c: joined.append(a.where("embedding IS NOT NULL").count()) or plain(a, *b, **c))
    path = (tmp_path / "lof").as_uri()
    model.save(spark, path)
    flat = lambda df: sorted((q["vec_id"], q["embedding"] or [], q["score"] if q["score"] is None else round(q["score"], 9)) for q in df.collect())
    for m in (model, D.load(spark, path)):
        assert flat(m.score(test)) == flat(want)
    few = plain(test.where("vec_id IN (200, 201)"), train, 6).groupBy("id").agg(F.count("*").alias("n")).collect()
    assert [q["n"] for q in few] == [6, 6]
    # joined: id 7 twice, id 9 twice, 12 (moved), 200 and 201
    assert joined == [7, 7]


def test_candidates_of_single_precision():
    """The k nearest are those of double precision: copies, ties, shared ids, vectors far from the origin, very long and very short ones."""
    r = np.random.Generator(np.random.PCG64(9))
    for case in range(40):
        d, m, k = int(r.integers(1, 9)), int(r.integers(1, 80)), int(r.integers(1, 12))
        scale = 10.0 ** int(r.integers(-120, 110) if case % 5 == 0 else r.integers(-8, 8))
        y = r.standard_normal((m, d)).round(int(r.integers(0, 6))) * scale + (case % 3) * scale * 10.0 ** int(r.integers(-3, 9))
        x = np.vstack([y[r.integers(0, m, 10)], r.standard_normal((10, d)) * scale + y.mean(0), y[:3] + scale * 1e-7])
        y_ids, ids = r.integers(0, m + 1, m), r.integers(0, m + 1, len(x))
        theta = np.full(len(x), np.inf) if case % 4 else np.abs(r.standard_normal(len(x))) * scale * d
        row, near, dist = neighbors.nearest_rows(x, ids, theta, neighbors.Block(y, y_ids), k, bool(case % 2))
        want = []
        for i in range(len(x)):
            far = np.sqrt(((x[i] - y) ** 2).sum(1))
            ok = (far <= theta[i]) & ((y_ids != ids[i]) | (case % 2 == 0))
            want += [(i, y_ids[j], far[j]) for j in np.lexsort((y_ids, far)) if ok[j]][:k]
        assert [t for t in zip(row, near, dist, strict=True) if t[2] <= theta[t[0]]] == want, case


def test_join_has_a_partition_for_each_piece(spark):
    """Pieces of work (a block, and as many visits as a task answers) are not dealt to a fixed number of shuffle partitions."""
    cells = [(i % 12, 0, i, [float(i % 7), float(i)]) for i in range(240)]
    train = spark.createDataFrame(cells, "cell int, part int, id long, v array<double>")
    visits = train.withColumn("theta", F.lit(float("inf")))
    assert neighbors._meet(visits, train, 2, True, 20).rdd.getNumPartitions() >= 12


def _many(spark, rows: int = 300):
    """Texts of words of very different frequency, with ties, null texts, null and shared ids."""
    r = np.random.Generator(np.random.PCG64(11))
    words = [f"w{i}" for i in range(60)]
    texts = [None if i % 40 == 7 else " ".join(words[min(59, int(r.exponential(9)))] for _ in range(int(r.integers(0, 14)))) for i in range(rows)]
    table = [(None if i % 50 == 3 else i, t, "attack" if i % 3 == 0 else "valid") for i, t in enumerate(texts)]
    return spark.createDataFrame([*table, (None, "only here only here", "valid")], "doc_id long, text string, label string")


def test_grams_of_rare_words_are_not_counted(spark):
    """The vocabulary is that of all grams; tasks send numbers, and none for a gram with a rare word."""
    docs = _many(spark)
    for n, most in ((2, 5), (2, 40), (3, 30), (2, 10_000)):
        tokens, words = features.tokenize(F.col("text"), n=n), features.tokenize(F.col("text"))
        want = features.build_vocabulary(features.term_counts(docs, "doc_id", tokens), docs.count(), 1, 1.0, most)
        got = features.top_vocabulary(docs, "doc_id", tokens, most, words, n)
        assert [tuple(r) for r in got.select("term", "df", "tf", "idx").orderBy("idx").collect()] == [tuple(r) for r in want.select("term", "df", "tf", "idx").orderBy("idx").collect()]


def test_token_information_in_tasks(spark, monkeypatch):
    """Terms are ranked without a table of all terms of all documents: the same numbers, the same vectors."""
    docs = _many(spark).where("doc_id IS NOT NULL")
    tokens = features.tokenize(F.col("text"))
    want = dict(features.mi_discrete(features.term_counts(docs, "doc_id", tokens), docs, "tf").collect())
    got = dict(features.mi_tokens(docs, tokens).collect())
    assert got.keys() == want.keys() and all(np.isclose(got[t], want[t], atol=1e-12) for t in want)
    made, plain = {}, store.materialize
    monkeypatch.setattr(store, "materialize", lambda df, name: made.setdefault(name, plain(df, name)))
    runs.token_mi_sweep(docs, [3], D.Mahalanobis)
    best = [t for t, _ in sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]]
    assert "terms" not in made
    for r in made["vectors"].join(docs.select("doc_id", "text"), "doc_id").collect():
        assert sorted(r["embedding"]) == sorted(float((r["text"] or "").split().count(t)) for t in best)


def test_rows_are_encoded_where_they_are(spark):
    """No row of an encoder's input is shuffled; rows without an id or with a shared one have vectors of their own text."""
    docs = _many(spark)
    model = encoders.TfidfEncoder("doc_id", 20).fit(docs)
    for got in (model.encode(docs), model.rows(docs, ["doc_id"]), features.term_counts(docs, "doc_id", features.tokenize(F.col("text")), model.vocabulary.select("term"))):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(None, "w0 w1"), (1, "w0 w1"), (1, "w2"), (2, "zz")], "doc_id long, text string")
    v = [np.array(r["embedding"]) for r in model.encode(rows).collect()]
    assert np.allclose(v[0], v[1]) and np.isclose(np.linalg.norm(v[0]), 1) and (v[0] > 0).sum() == 2 and (v[2] > 0).sum() == 1 and not v[3].any()
    sparse = {r["n"]: (r["idx"], r["w"]) for r in model.rows(rows.withColumn("n", F.monotonically_increasing_id()), ["n"]).collect()}
    assert len(sparse) == 4 and sum(len(i) for i, _ in sparse.values()) == 5
