"""Experiment runs: one row a configuration; fits are reused where a sweep allows it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestlab.operators import detectors, encoders, features, joins, metrics, sampling, sparse_pca
from requestlab.sources import store

from . import grids

METRICS = ("precision", "recall", "f1", "accuracy", "fpr", "specificity")


def _stack(rows: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rows)


def evaluate(scored: DataFrame, max_fpr: float = 0.05, **columns) -> DataFrame:
    """One row: metrics at the budgeted threshold and the configuration's columns.

    Scores are written once, as the threshold takes several scans of them.
    """
    scored = store.materialize(scored.select("label", "score"), "scores")
    return metrics.metrics_at_fpr(scored, max_fpr).withColumns({k: F.lit(v) for k, v in columns.items()})


def normal(df: DataFrame) -> DataFrame:
    return df.where("label = 'valid'")


def text_vectors(docs: DataFrame, max_features: int, key: str = "doc_id", pattern: str = "word", n: int = 1) -> DataFrame:
    """Dense TF-IDF vectors ``key, label, embedding`` on the most frequent terms (fitted on valid rows)."""
    model = encoders.TfidfEncoder(key, max_features, pattern, n).fit(normal(docs))
    return model.encode(docs, [key, "label"])


def pca_detector_run(vectors: DataFrame, k: int, detector=None, **columns) -> DataFrame:
    """PCA on valid rows, a detector on the coordinates, metrics at 5 % false positives; ``vectors`` are written once."""
    vectors = store.materialize(vectors, "vectors")
    model = detectors.PcaDetector(detector or detectors.Mahalanobis(), k).fit(normal(vectors))
    return evaluate(model.score(vectors), k=k, **columns)


def normalization_effect(normalized: DataFrame, max_features: int, k: int, key: str = "request_id") -> DataFrame:
    """R1 twice: on the raw text and on the canonical one of the same requests (raw where normalisation failed)."""
    rows = store.materialize(normalized.select(key, "label", "request", F.coalesce("canonical", "request").alias("canonical")), "texts")
    out = []
    for name in ("request", "canonical"):
        docs = rows.select(key, "label", F.col(name).alias("text"))
        out.append(pca_detector_run(text_vectors(docs, max_features, key, "space"), k, input="raw" if name == "request" else "canonical"))
    return _stack(out)


def pca_sweep(vectors: DataFrame, dims: list[int], detector=detectors.Mahalanobis) -> DataFrame:
    """R2: one PCA fit at the largest dimension, its head for every other."""
    pca = features.PCA.fit(normal(vectors), max(dims))
    rows = []
    for k in dims:
        coords, model = store.materialize(pca.head(k).transform(vectors), "coordinates"), detector()
        rows.append(evaluate(model.fit(normal(coords)).score(coords), k=k, detector=model.name, explained=float(pca.explained[:k].sum())))
    return _stack(rows)


def text_pca(docs: DataFrame, max_features: int, k: int, key: str = "doc_id", pattern: str = "word", n: int = 1) -> tuple[features.PCA, DataFrame]:
    """Components of wide TF-IDF features, fitted on valid rows, and all rows' coordinates: ``key, label, embedding``.

    A row keeps its weights as arrays from the vocabulary to the coordinates.
    """
    model = encoders.TfidfEncoder(key, max_features, pattern, n).fit(normal(docs))
    rows = store.materialize(model.rows(docs, [key, "label"]), "weights")
    pca = sparse_pca.fit_rows(normal(rows), normal(rows).count(), model.size, k)
    coords = store.materialize(sparse_pca.transform_rows(pca, rows), "coordinates")
    store.discard(rows)
    return pca, coords


def text_pca_sweep(docs: DataFrame, max_features: int, dims: list[int], detector=detectors.Mahalanobis, key: str = "doc_id", pattern: str = "word", n: int = 1) -> DataFrame:
    """R2 on wide text features: one fit at the largest dimension, its head for every other."""
    pca, coords = text_pca(docs, max_features, max(dims), key, pattern, n)
    rows = []
    for k in dims:
        cut, model = coords.withColumn("embedding", F.slice("embedding", 1, k)), detector()
        rows.append(evaluate(model.fit(normal(cut)).score(cut), k=k, detector=model.name, terms=len(pca.mean), explained=float(pca.explained[:k].sum())))
    return _stack(rows)


def grid_run(vectors: DataFrame, cls, grid: dict[str, list], **fixed) -> DataFrame:
    """One row a combination of options; feed to ``pareto_frontier`` and ``best_run``.

    Fits share their passes where the detector can, all models score in one scan and all combinations are
    evaluated together, so scans of ``vectors`` do not grow with the grid.
    """
    vectors = store.materialize(vectors, "vectors")
    names = list(grid)
    configs = [dict(zip(names, values, strict=True)) for values in product(*grid.values())]
    if cls._scorer is detectors.Detector._scorer:  # scores come from a join
        return _stack(evaluate(cls(**c, **fixed).fit(normal(vectors)).score(vectors), run_id=i, **c) for i, c in enumerate(configs))
    models = grids.fit_all(cls, normal(vectors), [c | fixed for c in configs])
    scored = store.materialize(grids.score_arrays(vectors, grids.scorers(models)).select("label", "scores"), "scores")
    return grids.evaluate_arrays(scored, [c | {m: float(x.params[m]) for m in ("aic", "bic") if m in x.params} for c, x in zip(configs, models, strict=True)])


def tuned_run(vectors: DataFrame, cls, grid: dict[str, list], max_fpr: float = 0.05, **fixed) -> dict[str, DataFrame]:
    """R3/R4 to the end: the grid, its Pareto frontier, the best run, and that configuration fitted anew and evaluated."""
    rows = store.materialize(grid_run(vectors, cls, grid, **fixed), "grid")
    best = sampling.best_run(rows, max_fpr)
    options = {k: best.first()[k] for k in grid}
    model = cls(**options, **fixed).fit(normal(vectors))
    again = evaluate(model.score(vectors), max_fpr, **options)
    return {"grid": rows, "frontier": joins.pareto_frontier(rows, max_fpr), "best": best, "refit": again}


def lof_sweep(vectors: DataFrame, ks: list[int], key: str = "vec_id") -> DataFrame:
    """Neighbours are joined once at the largest k; smaller k use prefixes of the lists."""
    from requestlab.operators.detectors import LocalOutlierFactor as Lof

    train = normal(vectors).select(F.col(key).alias("vec_id"), "embedding")
    inner = joins.nearest_neighbors(train, train, max(ks), skip_self=True)
    outer = joins.nearest_neighbors(vectors.select(F.col(key).alias("vec_id"), "embedding"), train, max(ks), skip_self=True)
    rows = []
    for k in ks:
        model = Lof(k).fit(train, near=inner)
        rows.append(evaluate(model.score(vectors, key, max_k=outer), k=k))
    return _stack(rows)


def mi_sweep(vectors: DataFrame, ks: list[int], bins: int | None = 16) -> DataFrame:
    """Dimensions ranked by mutual information once, a detector on the best k."""
    ranked = best_dims(vectors, max(ks), bins)
    rows = []
    for k in ks:
        cut = features.select_dims(vectors, ranked[:k])
        rows.append(evaluate(detectors.Mahalanobis().fit(normal(cut)).score(cut), k=k))
    return _stack(rows)


def token_mi_sweep(docs: DataFrame, ks: list[int], make, key: str = "doc_id") -> DataFrame:
    """R7, tokens: terms ranked by mutual information with the class, a detector on the counts of the best k."""
    tokens = features.tokenize(F.col("text"))
    terms = [r["term"] for r in sampling.top_k(features.mi_tokens(docs, tokens), "mi", max(ks), "term").collect()]  # at most max(ks) rows
    vectors = store.materialize(features.in_rows(docs, [key, "label"], tokens, terms, [features.EMBEDDING], features.dense(len(terms))), "vectors")
    rows = []
    for k in ks:
        cut = vectors.withColumn("embedding", F.slice("embedding", 1, k))
        rows.append(evaluate(make().fit(normal(cut)).score(cut), k=k))
    return _stack(rows)


def best_dims(vectors: DataFrame, k: int, bins: int | None = 16) -> list[int]:
    """The k dimensions with the most information on the class."""
    return [r["dim"] for r in features.mi_continuous(vectors, bins=bins).orderBy(F.desc("mi"), "dim").limit(k).collect()]  # a row a dimension


def cross_dataset_run(a: DataFrame, b: DataFrame, make, k: int | None = None) -> DataFrame:
    """Fitted on one set, threshold and metrics on the other, both directions; with ``k`` on the best
    dimensions of the fitted set, which the other one takes over."""
    rows = []
    for name, train, test in (("a_to_b", a, b), ("b_to_a", b, a)):
        if k:
            dims = best_dims(train, k)
            train, test = features.select_dims(train, dims), features.select_dims(test, dims)
        rows.append(evaluate(make().fit(normal(train)).score(test), direction=name))
    return _stack(rows)


def compare_models(models: dict[str, DataFrame], key: str = "request_id") -> dict[str, DataFrame]:
    """Agreement, error overlap and regions of several models' predictions."""
    names = list(models)
    joined = store.materialize(joins.join_predictions(models, key), "predictions")
    return {
        "agreement": metrics.agreement_matrix(joined, names),
        "overlap": metrics.error_overlap(joined, names),
        "unique": metrics.unique_catches(joined, names),
        "venn": metrics.error_venn(joined, names),
    }


def train_test_report(df: DataFrame, detector, train_size: int, key: str = "vec_id", max_fpr: float = 0.05) -> dict[str, DataFrame]:
    """Fit on a valid sample, threshold on it, metrics, score statistics and histogram on the rest."""
    train, test = sampling.split_one_class(df, train_size, key=key)
    detector.fit(train)
    cut, _ = detector.set_threshold(train, max_fpr)
    scored = detector.predict(test, cut)
    return {
        "metrics": metrics.classification_metrics(metrics.confusion_matrix(scored)).withColumn("threshold", F.lit(cut)),
        "scores": metrics.score_stats(scored, ["label"]),
        "histogram": metrics.score_histogram(scored),
    }
