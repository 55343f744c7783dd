"""Grids of detectors: fits share their passes, all models score a row at once, all configurations are evaluated together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from requestlab.operators import detectors, metrics
from requestlab.sources import store


def score_arrays(df: DataFrame, scorers: list[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``scores``: what every scorer says of a row, one array from one scan; null where there is no vector.

    A scorer gives one number a row, or several.
    """

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        there = x.notna()
        if not there.any():
            return pd.Series([None] * len(x), dtype=object)
        v = np.stack(x[there]).astype(float)
        got = iter(np.concatenate([s(v).reshape(len(v), -1) for s in scorers], axis=1))
        return pd.Series([next(got) if t else None for t in there], dtype=object)

    return df.withColumn("scores", run("embedding"))


def _long(scored: DataFrame) -> DataFrame:
    return scored.where("scores IS NOT NULL").select("label", F.posexplode("scores").alias("run_id", "score"))


def _named(rows: DataFrame, configs: list[dict]) -> DataFrame:
    """Rows with the options of their configuration."""
    names = list(configs[0])
    mixed = {k for k in names if len({type(c[k]) for c in configs}) > 1}  # such as "scale" beside numbers
    table = rows.sparkSession.createDataFrame([(i, *(str(c[k]) if k in mixed else c[k] for k in names)) for i, c in enumerate(configs)], ["run_id", *names])
    return rows.join(F.broadcast(table), "run_id")  # a row a configuration


def evaluate_arrays(scored: DataFrame, configs: list[dict], max_fpr: float = 0.05) -> DataFrame:
    """Metrics of each configuration at its own threshold for ``max_fpr``: one aggregation over all, a row each."""
    long = _long(scored)
    cut = store.materialize(metrics.threshold_at_fpr(long, max_fpr, ["run_id"]).select("run_id", "threshold"), "thresholds")
    conf = metrics.confusion_matrix(metrics.predict(long, cut, ["run_id"]), by=["run_id"])
    return _named(metrics.classification_metrics(conf).join(store.beside(cut), "run_id"), configs)


def forest_search(vectors: DataFrame, n_estimators: list[int], max_samples: list[int | None], contamination: list[float], seed: int = 42) -> DataFrame:
    """Isolation forests of all sizes at all contaminations, each evaluated at its threshold on the fitted rows.

    Trees are grown once for the largest forest of each sample size, from one draw of rows; a smaller forest
    is its first trees.  A contamination only moves the threshold: rows are counted by how many of
    the thresholds they pass.  So the scans of ``vectors`` do not grow with the grid.
    """
    vectors = store.materialize(vectors, "vectors")
    normal = vectors.where(F.col("label") == metrics.VALID)
    cells = [{"max_samples": s, "n_estimators": t} for s in max_samples for t in n_estimators]
    models = detectors.IsolationForest.fit_all(normal, [{"seed": seed, "n_estimators": c["n_estimators"], "max_samples": c["max_samples"] or 256} for c in cells])
    scored = store.materialize(score_arrays(vectors, detectors.IsolationForest.scorers(models)).select("label", "scores"), "scores")
    long, levels = _long(scored), sorted(contamination)
    cuts = metrics.percentiles(long.where(F.col("label") == metrics.VALID), "score", [1 - c for c in levels], ["run_id"])
    cuts = store.materialize(cuts.select("run_id", F.array(*[f"p{i}" for i in range(len(levels))]).alias("cuts")), "cuts")
    passed = F.size(F.filter("cuts", lambda c: F.col("score") > c))
    hits = long.join(store.beside(cuts), "run_id").groupBy("run_id", (F.col("label") == metrics.ATTACK).alias("attack"), passed.alias("passed")).agg(F.count("*").alias("n"))
    # the i-th largest threshold is passed by the rows that pass more than len - 1 - i, as thresholds fall with the contamination
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("contamination"), F.lit(i).alias("i"), (F.col("passed") > len(levels) - 1 - i).alias("hit")) for i, c in enumerate(levels)]))
    rows = hits.select("run_id", "attack", "n", each.alias("x")).groupBy("run_id", "x.contamination", "x.i")
    count = lambda hit, attack: F.coalesce(F.sum(F.when((F.col("x.hit") == hit) & (F.col("attack") == attack), F.col("n"))), F.lit(0))
    conf = rows.agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, False).alias("tn"), count(False, True).alias("fn"))
    out = metrics.classification_metrics(conf).join(store.beside(cuts), "run_id").withColumn("threshold", F.get("cuts", F.col("i"))).drop("cuts", "i")
    out = _named(out, [{"n_estimators": c["n_estimators"], "max_samples": c["max_samples"] or 0} for c in cells])
    return out.withColumn("run_id", F.row_number().over(W.orderBy("run_id", "contamination")) - 1)  # a row a configuration


def fit_all(cls, normal: DataFrame, options: list[dict]) -> list:
    """A model for each of the options; fits share passes where the detector can."""
    return cls.fit_all(normal, options) if hasattr(cls, "fit_all") else [cls(**o).fit(normal) for o in options]


def scorers(models: list) -> list[Callable[[np.ndarray], np.ndarray]]:
    return type(models[0]).scorers(models) if hasattr(type(models[0]), "scorers") else [m._scorer() for m in models]
