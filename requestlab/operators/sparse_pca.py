"""Principal components of wide sparse features: block Lanczos on the long table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from requestlab.sources import store

from . import features

#: Numbers of a block (dimensions by columns) that every task holds, 400 MB; the driver holds four times as many.
BASIS = 50_000_000
#: Non-zero weights multiplied at once in a task.
CHUNK = 16_384


def sparse_rows(weights: DataFrame, key: str) -> DataFrame:
    """One row a document: ``key, idx, w``, its non-zero weights as two arrays."""
    some = weights.where("weight <> 0").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("weight").cast("double").alias("weight")))).alias("s"))
    return some.select(key, F.col("s.idx").alias("idx"), F.col("s.weight").alias("w"))


def _slices(pdf: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch, about CHUNK weights at a time: from, to, the terms they have and their weights as a dense matrix on these."""
    sizes = pdf["idx"].map(len).to_numpy()
    ends = np.cumsum(sizes)
    a = 0
    while a < len(pdf):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
        terms, at = np.unique(np.concatenate(pdf["idx"].iloc[a:b].to_list()), return_inverse=True)
        cell = np.repeat(np.arange(b - a), sizes[a:b]) * len(terms) + at
        x = np.bincount(cell, weights=np.concatenate(pdf["w"].iloc[a:b].to_list()), minlength=(b - a) * len(terms))
        yield a, b, terms.astype(np.int64), x.reshape(b - a, len(terms))
        a = b


def _times(rows: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """X'X Q for the centred rows X: each task multiplies its rows twice, and what it sends has the size of Q."""
    held = rows.sparkSession.sparkContext.broadcast((basis, mean @ basis))
    shape = basis.shape

    def fold(frames: Iterator[pd.DataFrame]) -> np.ndarray | None:
        q, shift = held.value
        out, rest, seen = np.zeros(shape), np.zeros(shape[1]), False
        for pdf in frames:
            for _, _, terms, x in _slices(pdf):
                y = x @ q[terms] - shift
                out[terms] += x.T @ y
                rest += y.sum(axis=0)
                seen = True
        return np.concatenate([out.ravel(), rest]) if seen else None

    v = features.task_sums(rows.select("idx", "w"), fold)
    held.destroy()
    return v[: shape[0] * shape[1]].reshape(shape), v[shape[0] * shape[1] :]


def fit(weights: DataFrame, n_rows: int, n_dims: int, k: int, key: str = "doc_id", over: int = 10, passes: int = 12, tol: float = 1e-4, seed: int = 42) -> features.PCA:
    """E9 for wide text features: the first ``k`` components of ``key, idx, weight``, a row a non-zero weight.

    ``n_rows`` counts all documents, those without a weight too; ``n_dims`` is the size of the vocabulary.
    No dense row and no matrix of all pairs of terms is built.  A random block of about k / 3 columns is
    multiplied by the centred covariance (the mean is taken off implicitly), its image made orthogonal to
    all before is the next block, and so on: one pass over the rows a block (block Lanczos).  Components come from the
    space of all blocks; it grows until the variance that its k best directions explain does by less than ``tol``.
    Blocks are held by the driver, one by the tasks; their size is checked.
    """
    return fit_rows(sparse_rows(weights, key), n_rows, n_dims, k, over, passes, tol, seed)


def fit_rows(sparse: DataFrame, n_rows: int, n_dims: int, k: int, over: int = 10, passes: int = 12, tol: float = 1e-4, seed: int = 42) -> features.PCA:
    """:func:`fit` on a row a document, its weights as the arrays ``idx`` and ``w``; rows without a weight may be left out."""
    size = min(max(8, -(-(k + over) // 3)), n_dims)
    if n_dims * size * passes > 4 * BASIS or n_dims * size > BASIS:
        raise ValueError(f"{passes} blocks of {n_dims} x {size} numbers are too large: fewer components or terms")
    rows = store.materialize(sparse.where(F.size("idx") > 0).select("idx", "w"), "sparse")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # few splits: deal the rows over the cores, once
        few, rows = rows, store.materialize(rows.repartition(cores), "sparse")
        store.discard(few)
    sums = rows.select(F.explode(F.arrays_zip("idx", "w")).alias("s")).groupBy("s.idx").agg(F.sum("s.w").alias("m"), F.sum(F.col("s.w") * F.col("s.w")).alias("q")).collect()  # a row a term
    mean, square = np.zeros(n_dims), 0.0
    for r in sums:
        mean[r["idx"]], square = r["m"] / n_rows, square + r["q"]
    if not sums or n_rows < 2:
        raise ValueError("no vectors to fit on")
    total = (square - n_rows * mean @ mean) / (n_rows - 1)
    empty = n_rows - rows.count()  # documents without a weight are minus the mean, once centred

    block = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((n_dims, size)))[0]
    basis, images, before = np.empty((n_dims, 0)), np.empty((n_dims, 0)), -np.inf
    for _ in range(passes):
        got, rest = _times(rows, block, mean)
        # the mean's share of X'XQ: rows with weights add -mean * sum of y, empty ones mean * (mean Q)
        image = (got - np.outer(mean, rest) + empty * np.outer(mean, mean @ block)) / (n_rows - 1)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        now = values[order].sum()
        if len(order) == k and now - before <= tol * now:
            break
        before = now
        for _ in range(2):  # twice, against rounding
            image = image - basis @ (basis.T @ image)
        block, left = np.linalg.qr(image)
        block = block[:, np.abs(np.diag(left)) > 1e-12 * total]
        if not block.shape[1] or basis.shape[1] + block.shape[1] > n_dims:
            break  # nothing is left outside the space
    store.discard(rows)
    components = (basis @ turn[:, order]).T
    components *= np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])[:, None]
    return features.PCA(mean, components, values[order] / total)


def transform_rows(pca: features.PCA, rows: DataFrame) -> DataFrame:
    """Rows with the arrays ``idx`` and ``w`` get ``embedding``, their coordinates, instead."""
    held = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(pca.components.T), pca.mean @ pca.components.T))
    keep = [c for c in rows.columns if c not in ("idx", "w")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comp, shift = held.value
        for pdf in frames:
            out = np.tile(-shift, (len(pdf), 1))
            full = np.flatnonzero(pdf["idx"].map(len).to_numpy())
            for a, b, terms, x in _slices(pdf.iloc[full]):
                out[full[a:b]] += x @ comp[terms]
            yield pdf[keep].assign(embedding=list(out))

    schema = StructType([*rows.select(*keep).schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    return rows.mapInPandas(run, schema)


def transform(pca: features.PCA, docs: DataFrame, weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``embedding``, their coordinates; documents without a weight are at the coordinates of zero."""
    origin = pca.mean @ pca.components.T
    held = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(pca.components.T), origin))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comp, shift = held.value
        for pdf in frames:
            out = [x @ comp[terms] - shift for _, _, terms, x in _slices(pdf)]
            if out:
                yield pd.DataFrame({"_key": pdf["_key"], "embedding": list(np.concatenate(out))})

    kind = docs.select(key).dtypes[0][1]
    got = sparse_rows(weights, key).withColumnRenamed(key, "_key").mapInPandas(run, f"_key {kind}, embedding array<double>")
    zero = F.lit([float(-x) for x in origin])
    return docs.join(got, F.col(key) == F.col("_key"), "left").select(*docs.columns, F.coalesce("embedding", zero).alias("embedding"))
