"""Neighbour-based mutual information over dimensions of any size: sorted ranges, halos and prefix sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from requestlab.sources import store

_EULER = 0.5772156649015329
_TOP = np.int64(np.iinfo(np.int64).max)


def digamma(n: Column) -> Column:
    """Digamma of whole numbers from 1 on: harmonic numbers, then the asymptotic series."""
    harmonic = [sum(1 / i for i in range(1, m)) - _EULER for m in range(1, 16)]
    x = n.cast("double")
    inv = 1 / (x * x)
    series = F.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))
    return F.when(n < 16, F.get(F.lit(harmonic), (n - 1).cast("int"))).otherwise(series)


def _places(v: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, neighbours one apart."""
    b = v.view(np.int64)
    return np.where(b >= 0, b, -(b & _TOP))


def _doubles(p: np.ndarray) -> np.ndarray:
    return np.where(p >= 0, p, (-p) | np.int64(np.iinfo(np.int64).min)).astype(np.int64).view(np.float64)


def first_at(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The smallest double above ``x`` whose distance from it, as computed, is ``r`` or more (r > 0).

    A sum x + r is rounded, so the place is settled by distances: near the sum where four doubles
    either way bracket it, else by bisection over the doubles between.
    """
    x, r = x.astype(np.float64), r.astype(np.float64)
    with np.errstate(over="ignore"):
        at, far = _places(x + r), _places(np.minimum(x + 2 * r, np.finfo(float).max))
    low, high = at - 4, at + 4
    near = (_doubles(low) - x < r) & (_doubles(high) - x >= r)
    low, high = np.where(near, low, _places(x)), np.where(near, high, far)
    while True:
        open_ = np.flatnonzero((high >> 1) - (low >> 1) > 1)
        if not len(open_):
            open_ = np.flatnonzero(high - low > 1)
            if not len(open_):
                return _doubles(high)
        a, b = low[open_], high[open_]
        mid = (a >> 1) + (b >> 1) + (a & b & 1)
        beyond = _doubles(mid) - x[open_] >= r[open_]
        high[open_], low[open_] = np.where(beyond, mid, b), np.where(beyond, a, mid)


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def _ball(x: pd.Series, r: pd.Series) -> pd.DataFrame:
    """What lies strictly between ``low`` and ``high`` is nearer to ``x`` than ``r``."""
    a, b = x.to_numpy(float), r.to_numpy(float)
    return pd.DataFrame({"low": -first_at(-a, b), "high": first_at(a, b)})


def _ranges(cells: DataFrame, *order: str) -> DataFrame:
    """Cells written in ranges of ``order``, each with the number ``part`` of its range."""
    return store.materialize(cells.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def _radii(cells: DataFrame, k: int) -> DataFrame:
    """Cells ``dim, x, label, c`` with ``near`` (neighbours asked for) and ``radius``, the distance of the last of them.

    A range sees k values of the same class beyond each of its ends (its halo), so neighbours are
    found inside ranges; no dimension and no class is sorted in one task.
    """
    own = ["dim", "label", "part"]
    w = W.partitionBy(*own)
    marked = cells.withColumn("up", F.row_number().over(w.orderBy("x"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("x"))))
    edges = marked.where((F.col("up") <= k) | (F.col("down") <= k))
    edges = store.materialize(edges.select(*own, "x", "c", "up", "down"), "edges")  # at most 2k values a range and class
    marks = edges.groupBy(*own).agg(F.lit(None).cast("double").alias("x"), F.lit(None).cast("long").alias("c"))

    def halo(side: str, down: bool) -> DataFrame:
        """The k values of the class next to a range, on the side of the smaller (``down``) or larger values."""
        some = edges.where(F.col(side) <= k).select(*own, "x", "c").unionByName(marks)
        # a mark comes before its range's own values, so of 2k rows before it k are values
        part, x = (F.col("part"), F.asc_nulls_first("x")) if down else (F.desc("part"), F.desc_nulls_first("x"))
        before = W.partitionBy("dim", "label").orderBy(part, x).rowsBetween(-2 * k, -1)
        got = some.withColumn("far", F.filter(F.collect_list(F.struct("x", "c")).over(before), lambda s: s["x"].isNotNull())).where("x IS NULL")
        got = got.select(*own, F.explode(F.slice("far", F.greatest(F.lit(1), F.size("far") - k + 1), k)).alias("s"))
        return got.select(*own, F.col("s.x").alias("x"), F.col("s.c").alias("c"), F.lit(True).alias("halo"))

    rows = cells.select(*own, "x", "c", F.lit(False).alias("halo")).unionByName(halo("down", True)).unionByName(halo("up", False))
    total = cells.groupBy("dim", "label").agg(F.sum("c").alias("of_class"))
    w = w.orderBy("x")
    side = [F.struct((F.abs(f("x", i).over(w) - F.col("x"))).alias("d"), f("c", i).over(w).alias("c")) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    rows = rows.withColumn("around", F.array(F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("c")), *side)).where("NOT halo").drop("halo")
    rows = rows.join(total.hint("merge"), ["dim", "label"]).where("of_class > 1")
    rows = rows.withColumn("near", F.least(F.lit(k), F.col("of_class") - 1))
    # the near-th distance, each counted as often as its value occurs
    each = F.transform(F.filter("around", lambda s: s["d"].isNotNull()), lambda s: F.array_repeat(s["d"], F.least(F.lit(k), s["c"]).cast("int")))
    return rows.withColumn("radius", F.get(F.array_sort(F.flatten(each)), F.col("near").cast("int") - 1)).drop("around", "part")


def mutual_information(vectors: DataFrame, k: int = 3) -> DataFrame:
    """Mutual information (nats) of each dimension with the class by the k nearest of the same class: ``dim, mi``.

    The estimator of Ross (2014) with ties and rounding as its common implementation has them: the
    radius of a value is just below the distance of its k-th nearest neighbour of the same class, and the rows
    of any class within it are counted, itself included.  Classes of one row are left out, of k or fewer rows use all others.

    Equal values of a class are one cell with a count.  Cells are dealt by ranges of (dimension, value);
    neighbours come from a range and its halo, counts within a radius from running sums inside ranges
    and sums of ranges.  Null vectors, labels and values, and values that are not numbers, do not count.
    """
    long = vectors.where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("dim", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    # -0.0 and 0.0 are one value
    cells = long.groupBy("dim", (F.col("x").cast("double") + 0.0).alias("x"), "label").agg(F.count("*").alias("c"))
    cells = _ranges(cells, "dim", "x")
    radii = store.materialize(_radii(cells, k), "radii")

    tied = cells.groupBy("dim", "x").agg(F.sum("c").alias("inside"))
    still = radii.where("radius = 0").join(tied.hint("merge"), ["dim", "x"]).select("dim", "label", "x", "c", "near", "of_class", "inside")

    ball = radii.where("radius > 0").withColumn("ball", _ball("x", "radius"))
    at = F.array(F.struct(F.col("ball.low").alias("v"), F.lit(2).alias("kind")), F.struct(F.col("ball.high").alias("v"), F.lit(0).alias("kind")))
    asked = ball.select("dim", "label", "x", "c", "near", "of_class", F.explode(at).alias("at")).select("dim", F.col("at.v").alias("v"), "at.kind", "label", "x", F.lit(0).alias("n"))
    # in the order of values: a high end (0) before the rows at its value (1), a low end (2) behind them
    points = cells.select("dim", F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast(cells.schema["label"].dataType).alias("label"), F.lit(None).cast("double").alias("x"), F.col("c").alias("n"))
    line = _ranges(points.unionByName(asked), "dim", "v", "kind")
    inside = F.sum("n").over(W.partitionBy("dim", "part").orderBy("v", "kind"))  # equal (v, kind) are one frame
    parts = line.groupBy("dim", "part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("dim").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("dim", "part", before.alias("before"))
    line = line.withColumn("below", inside).where("kind <> 1").join(parts.hint("merge"), ["dim", "part"])
    count = line.groupBy("dim", "label", "x").agg(F.sum(F.when(F.col("kind") == 0, F.col("below") + F.col("before")).otherwise(-F.col("below") - F.col("before"))).alias("inside"))
    moved = radii.where("radius > 0").join(count.hint("merge"), ["dim", "label", "x"]).select(*still.columns)

    n = F.sum("c")
    part = F.sum(F.col("c") * (digamma(F.col("near")) - digamma(F.col("of_class")) - digamma(F.greatest("inside", F.lit(1)))))
    got = still.unionByName(moved).groupBy("dim").agg(F.greatest(digamma(n) + part / n, F.lit(0.0)).alias("mi"))
    every = cells.select("dim").distinct()
    return every.join(got, "dim", "left").select("dim", F.coalesce("mi", F.lit(0.0)).alias("mi"))
