"""Encoders: fitted on texts, they add ``embedding``; one contract for all."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from requestlab.sources import store

from . import features


class Encoder:
    """``fit`` learns from ``key, text``; ``encode`` adds ``embedding`` (array<double>) to every row and keeps its columns."""

    name = ""

    def fit(self, docs: DataFrame) -> Encoder:
        raise NotImplementedError

    def encode(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError


class TfidfEncoder(Encoder):
    """TF-IDF on the most frequent terms of the fitted texts; the vocabulary is a written table ``term, idx, df, tf``."""

    name = "tfidf"

    def __init__(self, key: str = "doc_id", max_features: int = 5000, pattern: str = "word", n: int = 1, min_df: float = 1, max_df: float = 1.0):
        self.options = {"key": key, "max_features": max_features, "pattern": pattern, "n": n, "min_df": min_df, "max_df": max_df}
        self.vocabulary, self.n_docs, self.size = None, 0, 0

    def _tokens(self) -> Column:
        return features.tokenize(F.col("text"), self.options["pattern"], self.options["n"])

    def fit(self, docs: DataFrame) -> TfidfEncoder:
        o = self.options
        self.n_docs = docs.count()
        if o["max_features"] is not None and features.all_df(self.n_docs, o["min_df"], o["max_df"]):
            words = features.top_vocabulary(docs, o["key"], self._tokens(), o["max_features"], features.tokenize(F.col("text"), o["pattern"]), o["n"])
        else:
            words = features.build_vocabulary(features.term_counts(docs, o["key"], self._tokens()), self.n_docs, o["min_df"], o["max_df"], o["max_features"], o["key"])
        self.vocabulary = store.materialize(words, "vocabulary")
        self.size = self.vocabulary.count()
        return self

    def weights(self, docs: DataFrame) -> DataFrame:
        """The long form ``key, term, idx, weight``, a row a non-zero weight; for vocabularies too wide for ``encode``."""
        if self.vocabulary is None:
            raise RuntimeError("tfidf: fit first")
        counts = features.term_counts(docs, self.options["key"], self._tokens(), self.vocabulary.select("term"))
        counts = counts.groupBy(self.options["key"], "term").agg(F.sum("tf").alias("tf"))
        return features.tfidf(counts, self.vocabulary, self.n_docs, self.options["key"])

    def _weighted(self, docs: DataFrame, keep: list[str], fields: list[StructField], make) -> DataFrame:
        """:func:`features.in_rows` with weights instead of counts."""
        if self.vocabulary is None:
            raise RuntimeError("tfidf: fit first")
        words = self.vocabulary.select("term", "df").orderBy("idx").collect()  # ``size`` rows
        idf = np.array([math.log((1 + self.n_docs) / (1 + r["df"])) + 1 for r in words])

        def weigh(n: int, row: np.ndarray, at: np.ndarray, tf: np.ndarray) -> list[pa.Array]:
            w = tf * idf[at]
            return make(n, row, at, w / np.sqrt(np.bincount(row, weights=w * w, minlength=n))[row])

        return features.in_rows(docs, keep, self._tokens(), [r["term"] for r in words], fields, weigh)

    def rows(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep, idx, w``: the non-zero weights of each row as two arrays; for vocabularies too wide for ``encode``."""

        def make(n: int, row: np.ndarray, at: np.ndarray, w: np.ndarray) -> list[pa.Array]:
            start = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            return [pa.ListArray.from_arrays(start, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(start, pa.array(w))]

        return self._weighted(docs, keep, [StructField("idx", ArrayType(IntegerType())), StructField("w", ArrayType(DoubleType()))], make)

    def encode(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """With ``keep``, of the columns of ``docs`` only these."""
        return self._weighted(docs, docs.columns if keep is None else keep, [features.EMBEDDING], features.dense(self.size))

    def save(self, spark: SparkSession, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}-vocabulary")
        body = json.dumps({"options": self.options, "n_docs": self.n_docs, "vocabulary": f"{path}-vocabulary"})
        spark.createDataFrame([(self.name, body)], "name string, body string").coalesce(1).write.mode("overwrite").parquet(path)


class FlagEncoder(Encoder):
    """Counts of listed flags in ``all_flags`` of normalised requests; nothing is learnt."""

    name = "flags"

    def __init__(self, names: list[str]):
        self.names = list(names)

    def fit(self, docs: DataFrame) -> FlagEncoder:
        return self

    def encode(self, docs: DataFrame) -> DataFrame:
        count = lambda n: F.size(F.filter("all_flags", lambda f: f == n)).cast("double")
        return docs.withColumn("embedding", F.array(*[count(n) for n in self.names]))

    def save(self, spark: SparkSession, path: str) -> None:
        body = json.dumps({"names": self.names})
        spark.createDataFrame([(self.name, body)], "name string, body string").coalesce(1).write.mode("overwrite").parquet(path)


ENCODERS: dict[str, type] = {c.name: c for c in (TfidfEncoder, FlagEncoder)}


def load(spark: SparkSession, path: str) -> Encoder:
    """A saved encoder."""
    row = spark.read.parquet(path).first()
    body = json.loads(row["body"])
    if row["name"] == "flags":
        return FlagEncoder(body["names"])
    out = TfidfEncoder(**body["options"])
    out.n_docs, out.vocabulary = body["n_docs"], spark.read.parquet(body["vocabulary"])
    out.size = out.vocabulary.count()
    return out
