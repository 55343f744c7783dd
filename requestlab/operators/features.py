"""Text and vector features as DataFrame jobs over long tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from requestlab.functions import text as T
from requestlab.sources import store

from . import metrics, neighbor_mi


def tokenize(text: Column, pattern: str = "word", n: int = 1) -> Column:
    """Terms of a text. ``word``: lower-cased words of two or more letters; ``space``: non-blank runs, case kept.

    With n > 1, also the n-grams up to n, joined by a space.
    """
    text = F.coalesce(text, F.lit(""))
    if pattern == "word":
        base = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    else:
        base = F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0))
    if n == 1:
        return base

    def grams(t: Column) -> list[Column]:
        """Grams of one term, of two, and so on: the shorter ones, each with the term behind it."""
        out = [t]
        for k in range(2, n + 1):
            left = F.greatest(F.size(t) - (k - 1), F.lit(0))
            out.append(F.zip_with(F.slice(out[-1], F.lit(1), left), F.slice(t, F.lit(k), left), lambda a, b: F.concat(a, F.lit(" "), b)))
        return out

    whole = F.transform(F.array(base), lambda t: F.flatten(F.array(*grams(t))))
    return F.element_at(whole, 1)


def flat_tokens(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a batch and the row of each."""
    return tokens.flatten(), np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))


def places(tokens: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each token in ``known``, -1 where it is not there."""
    return pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def found(tokens: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a batch, places in ``known`` and how often the row has that term, in this order."""
    flat, row = flat_tokens(tokens)
    at = places(flat, known)
    code, tf = np.unique((row * len(known) + at)[at >= 0], return_counts=True)
    return code // len(known), code % len(known), tf


EMBEDDING = StructField("embedding", ArrayType(DoubleType()))


def in_rows(docs: DataFrame, keep: list[str], tokens: Column, terms: list[str], fields: list[StructField], make: Callable[..., list[pa.Array]]) -> DataFrame:
    """``keep`` and ``fields``, which ``make`` builds of 1,024 rows: it gets their number, and row, place in ``terms`` and count of each cell.

    Each row of ``docs`` is a document, counted where it is: nothing is shuffled and no key is asked for.
    """
    known, names = pa.array(terms, pa.string()), [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *make(some.num_rows, *found(some.column(len(keep)), known))], names=names)

    return docs.select(*keep, tokens.alias("_tokens")).mapInArrow(run, StructType([*docs.select(*keep).schema.fields, *fields]))


def dense(size: int) -> Callable[..., list[pa.Array]]:
    """Cells of :func:`in_rows` as one vector of ``size`` numbers a row."""

    def make(n: int, row: np.ndarray, at: np.ndarray, v: np.ndarray) -> list[pa.Array]:
        out = np.zeros((n, size))
        out[row, at] = v
        return [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(out.ravel()))]

    return make


def term_counts(docs: DataFrame, key: str, tokens: Column, only: DataFrame | None = None) -> DataFrame:
    """Long table ``key, term, tf``; of the terms of ``only`` (a column ``term``), if given.

    With ``only``, each row of ``docs`` is a document and its terms are counted where it is, without a shuffle: rows that share a
    key stay apart.
    """
    if only is None:
        return T.unnest(docs, tokens, "term", key).groupBy(key, "term").agg(F.count("*").alias("tf"))
    terms = [r["term"] for r in only.limit(store.FEW + 1).collect()]
    if len(terms) > store.FEW:
        docs = docs.withColumn("_row", F.monotonically_increasing_id())
        rows = T.unnest(docs, tokens, "term", key, "_row").join(only, "term", "left_semi")
        return rows.groupBy(key, "_row", "term").agg(F.count("*").alias("tf")).drop("_row")
    known = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, tf = found(batch.column(1), known)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), known.take(pa.array(at)), pa.array(tf)], names=[key, "term", "tf"])

    kind = docs.select(key).dtypes[0][1]
    return docs.select(key, tokens.alias("_tokens")).mapInArrow(run, f"`{key}` {kind}, term string, tf long")


def all_df(n_docs: int, min_df: float, max_df: float) -> bool:
    """Whether the bounds on document frequencies exclude no term of a document with a key."""
    low = min_df if isinstance(min_df, int) else min_df * n_docs
    high = max_df if isinstance(max_df, int) else max_df * n_docs
    return 0 < low <= 1 and high >= n_docs


def _top_grams(docs: DataFrame, key: str, words: Column, n: int, max_features: int) -> DataFrame | None:
    """``term, tf`` of the ``max_features`` most frequent words and grams up to ``n`` words; None where it does not bound the words.

    A gram occurs no more often than each of its words.  So only grams of words that occur as often as the last of the
    ``max_features`` most frequent words can be among the terms; tasks count them as numbers.
    """
    spark = docs.sparkSession
    single = T.unnest(docs, words, "term", key).groupBy("term").agg(F.count("*").alias("tf"), F.count(key).alias("n"))
    single = store.materialize(single, "words")
    last = single.where("n > 0").orderBy(F.desc("tf"), "term").limit(max_features).agg(F.count("*").alias("c"), F.min("tf").alias("tf")).first()
    least = last["tf"] if last["c"] == max_features else 1
    # a word that only rows without a key have is in no gram that counts
    often = single.where((F.col("tf") >= least) & (F.col("n") > 0))
    known = [r["term"] for r in often.select("term").limit(store.FEW + 1).collect()]
    if len(known) > store.FEW or len(known) ** n >= 2**62:
        store.discard(single)
        return None
    held = spark.sparkContext.broadcast(pa.array(known, pa.string()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = flat_tokens(batch.column(1))
            at, keyed = places(flat, held.value), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            code, ok = at, at >= 0
            for k in range(2, n + 1):
                m = max(0, len(at) - k + 1)
                ok, code = ok[:m] & (at[k - 1 :] >= 0) & (row[k - 1 :] == row[:m]), code[:m] * len(held.value) + at[k - 1 :]
                got, tf = np.unique(code[ok], return_counts=True)
                own = tf
                if not keyed.all():
                    own = np.bincount(np.searchsorted(got, code[ok]), weights=keyed[row[:m][ok]], minlength=len(got)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), k, np.int32)), pa.array(got), pa.array(tf), pa.array(own)], names=["k", "code", "tf", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, size = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            term = [" ".join(held.value[int(c) // len(held.value) ** j % len(held.value)].as_py() for j in range(k - 1, -1, -1)) for c, k in zip(code, size, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), batch.column(2)], names=["term", "tf"])

    grams = docs.select(F.col(key), words.alias("words")).mapInArrow(count, "k int, code long, tf long, n long")
    grams = grams.groupBy("k", "code").agg(F.sum("tf").alias("tf"), F.sum("n").alias("n")).where((F.col("n") > 0) & (F.col("tf") >= least))
    terms = often.select("term", "tf").unionByName(grams.select("k", "code", "tf").mapInArrow(spell, "term string, tf long"))
    out = store.materialize(terms.orderBy(F.desc("tf"), "term").limit(max_features), "terms")
    held.destroy()
    store.discard(single)
    return out


def top_vocabulary(docs: DataFrame, key: str, tokens: Column, max_features: int, words: Column | None = None, n: int = 1) -> DataFrame:
    """E2 without bounds on document frequencies: the table of :func:`build_vocabulary`.

    Terms are ranked by occurrences alone, which tasks add up before the shuffle; documents are counted for the
    chosen terms only, so no row for every term of every document is shuffled.  With ``words``, of which ``tokens``
    has the grams up to ``n``, grams of rare words are not counted.
    """
    top = _top_grams(docs, key, words, n, max_features) if words is not None and n > 1 else None
    if top is None:
        every = T.unnest(docs, tokens, "term", key).groupBy("term").agg(F.count("*").alias("tf"), F.count(key).alias("n")).where("n > 0").drop("n")
        top = store.materialize(every.orderBy(F.desc("tf"), "term").limit(max_features), "terms")
    own = term_counts(docs.where(F.col(key).isNotNull()), key, tokens, top.select("term"))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    got = top.join(df, "term").select("term", "df", "tf")
    return got.withColumn("idx", F.row_number().over(W.orderBy("term")) - 1)


def build_vocabulary(counts: DataFrame, n_docs: int, min_df: float = 1, max_df: float = 1.0, max_features: int | None = None, key: str = "doc_id") -> DataFrame:
    """``term, idx, df, tf``: document-frequency bounds (int: documents, float: share), the most frequent
    ``max_features`` terms (ties by term), numbered alphabetically."""
    low = min_df if isinstance(min_df, int) else min_df * n_docs
    high = max_df if isinstance(max_df, int) else max_df * n_docs
    got = counts.groupBy("term").agg(F.count(key).alias("df"), F.sum("tf").alias("tf")).where((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        got = got.orderBy(F.desc("tf"), "term").limit(max_features)
    return got.withColumn("idx", F.row_number().over(W.orderBy("term")) - 1)


def count_vectors(counts: DataFrame, vocabulary: DataFrame, key: str = "doc_id", binary: bool = False) -> DataFrame:
    """``key, idx, tf`` on a fixed vocabulary."""
    tf = F.lit(1).cast("long") if binary else F.col("tf")
    return counts.join(vocabulary.select("term", "idx"), "term").select(key, "term", "idx", tf.alias("tf"))


def tfidf(counts: DataFrame, vocabulary: DataFrame, n_docs: int, key: str = "doc_id", smooth: bool = True, sublinear: bool = False, normalize: bool = True) -> DataFrame:
    """``key, term, idx, weight``: tf * idf with L2-normalised rows."""
    df = F.col("df").cast("double")
    idf = F.log((1 + n_docs) / (1 + df)) + 1 if smooth else F.log(n_docs / df) + 1
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    got = counts.select(key, "term", "tf").join(vocabulary.select("term", "idx", "df"), "term").withColumn("weight", tf * idf)
    if normalize:
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(key)))
        got = got.withColumn("weight", F.col("weight") / norm)
    return got.select(key, "term", "idx", "weight")


def mi_discrete(weights: DataFrame, labels: DataFrame, value: str = "weight", key: str = "doc_id") -> DataFrame:
    """Mutual information (nats) of each term's value, as a category, with the class.

    Only non-zero values are rows; the zero cell of a term and class is what its other cells
    leave of the class.
    """
    totals = labels.groupBy("label").agg(F.count("*").alias("n_label"))
    n = F.sum("n_label").over(W.partitionBy())
    totals = totals.withColumn("n", n)
    cells = weights.join(labels.select(key, "label"), key).groupBy("term", F.col(value).alias("v"), "label").agg(F.count("*").alias("c"))
    seen = cells.groupBy("term", "label").agg(F.sum("c").alias("c"))
    every = seen.select("term").distinct().crossJoin(F.broadcast(totals))  # a row a class
    zero = every.join(seen, ["term", "label"], "left").select(
        "term", F.lit(None).cast("double").alias("v"), "label", (F.col("n_label") - F.coalesce("c", F.lit(0))).alias("c")
    )
    cells = cells.select("term", F.col("v").cast("double").alias("v"), "label", "c").unionByName(zero).where("c > 0")
    cells = cells.withColumn("c_v", F.sum("c").over(W.partitionBy("term", "v"))).join(F.broadcast(totals), "label")
    p = F.col("c") / F.col("n")
    part = p * F.log(F.col("c") * F.col("n") / (F.col("c_v") * F.col("n_label")))
    return cells.groupBy("term").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("mi"))


def mi_tokens(docs: DataFrame, tokens: Column) -> DataFrame:
    """E6 of how often each term occurs in a row: ``term, mi``; as :func:`mi_discrete`, but each row of ``docs`` is a document.

    Tasks count a row's terms where it is and send how many rows of a class have a term so often; no table of
    all terms of all documents is made.  Rows without a label do not count.
    """
    docs = docs.where("label IS NOT NULL")
    totals = docs.groupBy("label").count().orderBy("label").collect()  # a row a class
    n, own = sum(r["count"] for r in totals), [r["count"] for r in totals]
    label = F.array_position(F.lit([r["label"] for r in totals]), F.col("label")).cast("int") - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = flat_tokens(batch.column(1))
            if not len(flat):
                continue
            flat = flat.dictionary_encode()
            words, of = len(flat.dictionary), batch.column(0).to_numpy()
            code, tf = np.unique(row * words + flat.indices.to_numpy(), return_counts=True)
            cell = (code % words * (tf.max() + 1) + tf) * len(own) + of[code // words]
            cell, c = np.unique(cell, return_counts=True)
            v = cell // len(own)
            columns = [flat.dictionary.take(pa.array(v // (tf.max() + 1))), pa.array(v % (tf.max() + 1)), pa.array((cell % len(own)).astype(np.int32)), pa.array(c)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "v", "label", "c"])

    cells = docs.select(label.alias("label"), tokens.alias("_tokens")).mapInArrow(run, "term string, v long, label int, c long")
    names = [f"c{i}" for i in range(len(own))]
    cells = cells.groupBy("term", "v").agg(*[F.coalesce(F.sum(F.when(F.col("label") == i, F.col("c"))), F.lit(0)).alias(c) for i, c in enumerate(names)])

    def part(counts: list[Column]) -> Column:
        """What the rows with one value of a term add."""
        every = reduce(add, counts)
        return reduce(add, [F.when(c > 0, c / n * F.log(c * n / (every * m))).otherwise(0.0) for c, m in zip(counts, own, strict=True)])

    terms = cells.groupBy("term").agg(F.sum(part([F.col(c) for c in names])).alias("there"), *[F.sum(c).alias(c) for c in names])
    return terms.select("term", F.greatest(F.col("there") + part([m - F.col(c) for c, m in zip(names, own, strict=True)]), F.lit(0.0)).alias("mi"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma by recurrence and its asymptotic series (no scipy)."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out[small] -= 1 / x[small]
        x[small] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def mi_continuous(vectors: DataFrame, k: int = 3, bins: int | None = 16) -> DataFrame:
    """Mutual information (nats) of each dimension with the class: ``dim, mi``.

    With ``bins``: dimensions are cut at their exact quantiles, all native, for tables of any size.
    ``bins`` = None: the nearest-neighbour estimator of Ross (2014), by sorted ranges (``neighbor_mi``).
    """
    if not bins:
        return neighbor_mi.mutual_information(vectors, k)
    long = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    shares = [i / bins for i in range(1, bins)]
    cuts = metrics.percentiles(long, "x", shares, ["dim"])
    cuts = cuts.select(F.col("dim").alias("_dim"), F.array(*[f"p{i}" for i in range(len(shares))]).alias("cuts"))
    cells = long.join(F.broadcast(cuts), F.col("dim") == F.col("_dim"))  # a row a dimension
    cells = cells.select("dim", "label", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("b")).groupBy("dim", "b", "label").agg(F.count("*").alias("c"))
    n, nb, nl = (F.sum("c").over(W.partitionBy("dim", *by)) for by in ([], ["b"], ["label"]))
    part = (F.col("c") / n) * F.log(F.col("c") * n / (nb * nl))
    return cells.withColumn("part", part).groupBy("dim").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("mi"))


def nearest_mi(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Mutual information of a number and a class by the k nearest of the same class."""
    radius, used, own, near = np.zeros(len(x)), np.zeros(len(x), bool), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        if len(at) < 2:
            continue
        kk = min(k, len(at) - 1)
        order = at[np.argsort(x[at], kind="stable")]
        v = x[order]
        pad = np.concatenate([np.full(kk, -np.inf), v, np.full(kk, np.inf)])
        gaps = np.stack([np.abs(pad[kk + s : kk + s + len(v)] - v) for s in range(-kk, kk + 1) if s], axis=1)
        radius[order] = np.nextafter(np.sort(gaps, axis=1)[:, kk - 1], 0)
        used[at], own[at], near[at] = True, len(at), kk
    s = np.sort(x)
    low, high = np.searchsorted(s, x - radius, side="left"), np.searchsorted(s, x + radius, side="right")
    inside = lambda i: (i >= 0) & (i < len(s)) & (np.abs(s[np.clip(i, 0, len(s) - 1)] - x) <= radius)
    for _ in range(4):  # x + radius is rounded: the ends are settled by distances, as the radius was
        high, low = high - ~inside(high - 1) + inside(high), low + ~inside(low) - inside(low - 1)
    m = high - low
    u = used
    if not u.any():
        return 0.0
    mi = digamma(np.array([u.sum()]))[0] + digamma(near[u]).mean() - digamma(own[u]).mean() - digamma(np.maximum(m[u], 1)).mean()
    return max(0.0, mi)


def select_dims(vectors: DataFrame, dims: list[int], column: str = "embedding") -> DataFrame:
    """Vectors cut to the given dimensions, in their order."""
    return vectors.withColumn(column, F.transform(F.lit(dims), lambda i: F.get(F.col(column), i)))


def task_sums(df: DataFrame, fold: Callable[[Iterator[pd.DataFrame]], np.ndarray | None]) -> np.ndarray:
    """Sum over all tasks of the array that ``fold`` makes of a task's rows.

    Tasks' arrays are added while they stream through at most 64 second tasks, chosen by the number of
    the first one, so that no task and not the driver holds more than a few arrays at once.
    """

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = fold(frames)
        if total is not None:
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % 64], "v": [np.asarray(total, "<f8").tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            for v in pdf["v"]:
                total = np.frombuffer(v, "<f8").copy() if total is None else total + np.frombuffer(v, "<f8")
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    parts = df.mapInPandas(first, "slot int, v binary").repartition("slot").select("v")
    rows = parts.mapInPandas(add, "v binary").toLocalIterator()  # at most 64 rows
    total = None
    for r in rows:
        v = np.frombuffer(bytes(r["v"]), "<f8")
        total = v.copy() if total is None else total + v
    if total is None:
        raise ValueError("no vectors to fit on")
    return total


def _moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and Gram matrix of the vectors that are not null."""

    def fold(frames: Iterator[pd.DataFrame]) -> np.ndarray | None:
        n, s, g = 0, 0.0, 0.0
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["x"]).astype(float)
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        return np.concatenate([[n], s, g.ravel()]) if n else None

    v = task_sums(vectors.where(f"{column} IS NOT NULL").select(F.col(column).alias("x")), fold)
    d = math.isqrt(len(v))  # 1 + d + d^2 numbers
    return int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)


def mean_and_covariance(vectors: DataFrame, ddof: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    n, s, g = _moments(vectors)
    mean = s / n
    return n, mean, (g - n * np.outer(mean, mean)) / max(n - ddof, 1)


class PCA:
    """Principal components; coordinates are centred; the sign makes the largest loading positive."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, explained: np.ndarray):
        self.mean, self.components, self.explained = np.array(mean, float), np.array(components, float), np.array(explained, float)

    @classmethod
    def fit(cls, vectors: DataFrame, k: int) -> PCA:
        _, mean, cov = mean_and_covariance(vectors)
        values, axes = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:k]
        comp = axes[:, order].T
        comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
        return cls(mean, comp, values[order] / values.sum())

    def params(self) -> dict:
        """Plain numbers, from which ``PCA(**params)`` is the same again."""
        return {"mean": self.mean.tolist(), "components": self.components.tolist(), "explained": self.explained.tolist()}

    def head(self, k: int) -> PCA:
        """The first k components; a sweep over k fits once."""
        return PCA(self.mean, self.components[:k], self.explained[:k])

    def transform(self, vectors: DataFrame, column: str = "embedding") -> DataFrame:
        mean, comp = self.mean, self.components

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            there = x.notna()
            got = iter((np.stack(x[there]).astype(float) - mean) @ comp.T if there.any() else ())
            return pd.Series([next(got) if t else None for t in there], dtype=object)

        return vectors.withColumn(column, project(column))


def pca_2d(vectors: DataFrame, share: float = 1.0, key: str = "vec_id") -> DataFrame:
    """Two coordinates of a hash sample of rows."""
    from .sampling import hash_split

    some = vectors if share >= 1 else hash_split(vectors, share, key=key).where("part = 'train'").drop("part")
    got = PCA.fit(some, 2).transform(some)
    return got.withColumns({"x": F.col("embedding")[0], "y": F.col("embedding")[1]})


def _sums_by_key(rows: DataFrame, key: str, schema: str, fold: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows folded to one a key: ``fold`` makes one row a key of a batch, ``merge`` joins the rows of one key.

    Batches are folded before the shuffle and again behind it, where rows come sorted by key, so a key
    of any size takes the room of one row.
    """

    def before(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield fold(pdf)

    def behind(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            if not len(pdf):
                continue
            start = np.flatnonzero(np.append(True, pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]))
            for a, b in zip(start, np.append(start[1:], len(pdf)), strict=True):
                some = pdf.iloc[a:b]
                if held is not None and held[key].iloc[0] == some[key].iloc[0]:
                    held = merge(held, some)
                else:
                    if held is not None:
                        yield held
                    held = merge(some.iloc[:1], some.iloc[1:])
        if held is not None:
            yield held

    return rows.mapInPandas(before, schema).repartition(key).sortWithinPartitions(key).mapInPandas(behind, schema)


def mean_layers(first: Column, last: Column) -> Column:
    """The average of a token's vectors in two layers."""
    return F.zip_with(first, last, lambda a, b: (a.cast("double") + b.cast("double")) / 2)


def pool_tokens(tokens: DataFrame, key: str = "request_id", normalize: bool = False, layers: tuple[str, str] | None = None) -> DataFrame:
    """Mean then max of token vectors, special tokens left out; optionally L2-normalised.

    With ``layers`` a token's vector is the average of two columns, else the column ``vec``.
    """
    vec = mean_layers(*map(F.col, layers)) if layers else F.col("vec").cast("array<double>")
    rows = tokens.where(~F.coalesce(F.col("is_special"), F.lit(False)) & vec.isNotNull()).select(key, F.lit(1).alias("n"), vec.alias("total"), vec.alias("top"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf[key].to_numpy(), kind="stable")
        ids = pdf[key].to_numpy()[order]
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        total, top = (np.stack(pdf[c])[order] for c in ("total", "top"))
        n = np.add.reduceat(pdf["n"].to_numpy()[order], at)
        return pd.DataFrame({key: ids[at], "n": n, "total": list(np.add.reduceat(total, at)), "top": list(np.maximum.reduceat(top, at))})

    def merge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return fold(pd.concat([a, b]))

    kind = tokens.select(key).dtypes[0][1]
    out = _sums_by_key(rows, key, f"{key} {kind}, n long, total array<double>, top array<double>", fold, merge)
    out = out.select(key, F.concat(F.transform("total", lambda x: x / F.col("n")), "top").alias("embedding"))
    if normalize:
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        out = out.withColumn("embedding", F.when(norm > 0, F.transform("embedding", lambda x: x / norm)).otherwise(F.col("embedding")))
    return out


def fde_projections(width: int, reps: int, k_sim: int, dim: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hyperplanes and the +-1 projection of every repetition."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [(rng.standard_normal((width, k_sim)), rng.choice([-1.0, 1.0], (width, dim)) / math.sqrt(dim)) for _ in range(reps)]


def multi_vector_fde(tokens: DataFrame, key: str = "request_id", reps: int = 20, k_sim: int = 5, dim: int = 16, seed: int = 42) -> DataFrame:
    """One fixed vector from token vectors: per repetition, tokens fall into 2^k_sim sign buckets of random
    hyperplanes; a bucket holds the mean of its tokens under a random +-1 projection to ``dim``.

    Tasks add the projections of a request's tokens by bucket; what travels is one row a request and task with the
    buckets it has.
    """
    slots = reps << k_sim

    def rows_of(key_values: np.ndarray, owner: np.ndarray, slot: np.ndarray, n: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        """Sums by (request, slot) as one row a request."""
        code = owner * slots + slot
        order = np.argsort(code, kind="stable")
        at = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
        code, n, p = code[order][at], np.add.reduceat(n[order], at), np.add.reduceat(p[order], at)
        first = np.flatnonzero(np.append(True, code[1:] // slots != code[:-1] // slots))
        cut = lambda x: np.split(x, first[1:])
        return pd.DataFrame({key: key_values[code[first] // slots], "slot": cut(code % slots), "n": cut(n), "p": [x.ravel() for x in cut(p)]})

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"]).astype(float)
            planes = planes or fde_projections(x.shape[1], reps, k_sim, dim, seed)
            ids, owner = np.unique(pdf[key].to_numpy(), return_inverse=True)
            slot = np.concatenate([(r << k_sim) + ((x @ a) > 0) @ (1 << np.arange(k_sim)) for r, (a, _) in enumerate(planes)])
            p = np.concatenate([x @ b for _, b in planes])
            yield rows_of(ids, np.tile(owner, reps), slot, np.ones(len(slot), np.int64), p)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, owner = np.unique(pdf[key].to_numpy(), return_inverse=True)
        size = [len(s) for s in pdf["slot"]]
        slot, n, p = (np.concatenate(list(pdf[c])) for c in ("slot", "n", "p"))
        return rows_of(ids, np.repeat(owner, size), slot, n, p.reshape(-1, dim))

    kind = tokens.select(key).dtypes[0][1]
    schema = f"{key} {kind}, slot array<long>, n array<long>, p array<double>"
    rows = tokens.where(~F.coalesce(F.col("is_special"), F.lit(False)) & F.col("vec").isNotNull()).select(key, "vec").mapInPandas(start, schema)
    sums = _sums_by_key(rows, key, schema, fold, lambda a, b: fold(pd.concat([a, b])))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            full = np.zeros((len(pdf), slots, dim))
            for i, (slot, n, p) in enumerate(zip(pdf["slot"], pdf["n"], pdf["p"], strict=True)):
                full[i, slot] = np.reshape(p, (-1, dim)) / np.asarray(n)[:, None]
            yield pd.DataFrame({key: pdf[key], "embedding": list(full.reshape(len(pdf), -1))})

    return sums.mapInPandas(spread, f"{key} {kind}, embedding array<double>")


def flag_features(flags: DataFrame, names: list[str], key: str = "request_id") -> DataFrame:
    """Count of each listed flag per request as columns."""
    return flags.groupBy(key).agg(*[F.count_if(F.col("flag") == n).alias(n.lower()) for n in names])
