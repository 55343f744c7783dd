"""Joins of the request engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import nearest_neighbors

__all__ = ["attach_metadata", "join_predictions", "nearest_neighbors", "param_grid", "pareto_frontier", "project_vocabulary"]


def attach_metadata(vectors: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Bring request and label beside each vector, by key."""
    return vectors.join(requests, key)


def join_predictions(models: dict[str, DataFrame], key: str = "request_id", check: bool = True) -> DataFrame:
    """``key, label`` and one boolean column a model; a row that a model lacks is an error."""
    out = None
    for name, df in models.items():
        side = df.select(key, F.col("label").alias(f"_l_{name}"), F.col("prediction").alias(name))
        out = side if out is None else out.join(side, key, "full")
    label = F.coalesce(*[F.col(f"_l_{n}") for n in models])
    cols = [F.col(n) for n in models]
    if check:
        missing = F.lit(False)
        for c in cols:
            missing = missing | c.isNull()
        cols = [F.when(missing, F.raise_error(F.lit("models cover different rows"))).otherwise(F.col(n)).cast("boolean").alias(n) for n in models]
    return out.select(key, label.alias("label"), *cols)


def param_grid(spark, **levels) -> DataFrame:
    """C4: all combinations of a few listed levels, one column a parameter."""
    out = spark.range(1).select()
    for name, values in levels.items():
        out = out.select("*", F.explode(F.lit(list(values))).alias(name))
    return out


def pareto_frontier(runs: DataFrame, max_fpr: float, key: str = "run_id", fallback: int = 5) -> DataFrame:
    """Feasible runs (else the ``fallback`` of lowest fpr) that no other beats in recall and fpr at once.

    A run is beaten if a strictly smaller fpr comes with a strictly larger recall, so one
    ordered pass over the runs (a running maximum) replaces the comparison of all pairs.
    """
    from pyspark.sql import Window as W

    all_ = W.partitionBy()
    ok = runs.withColumn("_any", F.max((F.col("fpr") <= max_fpr).cast("int")).over(all_))
    ok = ok.withColumn("_r", F.row_number().over(W.orderBy("fpr", key)))
    ok = ok.where(F.when(F.col("_any") == 1, F.col("fpr") <= max_fpr).otherwise(F.col("_r") <= fallback))
    below = W.orderBy("fpr").rangeBetween(W.unboundedPreceding, 0)
    best = ok.groupBy("fpr").agg(F.max("recall").alias("_m"))
    best = best.withColumn("_before", F.max("_m").over(below.rowsBetween(W.unboundedPreceding, -1)))
    ok = ok.join(best.select("fpr", "_before"), "fpr")
    return ok.where("_before IS NULL OR _before <= recall").drop("_any", "_r", "_before").orderBy(F.desc("recall"), key)


def project_vocabulary(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows whose term is in the vocabulary."""
    return terms.join(vocabulary.select("term").distinct(), "term", "left_semi")
