"""Samples, splits, top-k and set operations.  Samples follow a hash of the id, so reruns and repartitioning agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from requestlab.sources import store

from . import metrics


def hash_order(key: str, seed: int = 42) -> Column:
    """A fixed shuffle of ids: md5 of id and seed (the same on any engine)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def split_one_class(df: DataFrame, train_size: int, seed: int = 42, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """G1: train = ``train_size`` random valid rows (all, if fewer); test = the other valid rows and all attacks.

    The sample is all valid rows up to one place in hash order, so both parts are filters.
    """
    valid = F.coalesce(F.col("label") == "valid", F.lit(False))
    last = _cutoffs(df.where(valid), F.lit("valid"), F.lit(train_size), seed, key).first()
    if last is None:
        return df.where("false"), df
    place = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["key"]).cast(df.schema[key].dataType).alias("key"))
    picked = F.coalesce(valid & (_place(key, seed) <= place), F.lit(False))
    return df.where(picked), df.where(~picked)


def _place(key: str, seed: int) -> Column:
    """Where a row stands in hash order."""
    return F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("key"))


def _cutoffs(df: DataFrame, group: Column, need: Column, seed: int, key: str) -> DataFrame:
    """Of every group the place ``h, key`` of its last row if the first ``need`` rows in hash order are taken: ``group, population, h, key``.

    ``need`` is an expression over the group's size ``population``.  Rows are counted by 65,536 ranges of their
    hash; only those of the one range that is taken in part are ranked.  A row a group is written.
    """
    h = hash_order(key, seed)
    rows = df.select(group.alias("group"), F.col(key).alias("key"), h.alias("h")).where("key IS NOT NULL").withColumn("b", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    w = W.partitionBy("group")
    hist = rows.groupBy("group", "b").agg(F.count("*").alias("c")).withColumn("population", F.sum("c").over(w))
    hist = hist.withColumn("before", F.sum("c").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).withColumn("need", need)
    last = hist.where("before < need").groupBy(F.col("group").alias("_g"), "population", "need").agg(F.max(F.struct("b", "before")).alias("cut"))
    last = store.materialize(last, "ranges")
    edge = rows.join(store.beside(last), F.col("group").eqNullSafe(F.col("_g")) & (F.col("b") == F.col("cut.b")))
    edge = edge.withColumn("r", F.row_number().over(w.orderBy("h", "key"))).where("r <= need - cut.before")
    got = edge.groupBy("group", "population").agg(F.max(F.struct("h", "key")).alias("p"))
    return store.materialize(got.select("group", "population", "p.h", "p.key"), "cutoffs")


def _first_by_hash(df: DataFrame, group: str, need: Column, seed: int, key: str) -> DataFrame:
    """Of every group the first rows in hash order, ``need`` many, with the group's size as ``population``.

    Groups' last places go to the rows, which stay where they are.  Rows that share an id go together;
    rows without an id are in no sample.
    """
    last = store.beside(_cutoffs(df, F.col(group), need, seed, key).select(F.col("group").alias("_g"), "population", F.struct("h", "key").alias("_last")))
    both = df.join(last, F.col(group).eqNullSafe(F.col("_g"))).where(_place(key, seed) <= F.col("_last"))
    return both.select(*df.columns, "population")


def sample_per_label(df: DataFrame, n: int, seed: int = 42, key: str = "request_id") -> DataFrame:
    """N rows of every label and the label's size as ``population``."""
    return _first_by_hash(df, "label", F.lit(n), seed, key)


def sample_per_category(df: DataFrame, categories: list[str], share: float = 0.15, seed: int = 42, key: str = "request_id") -> DataFrame:
    """Of every 0/1 category max(1, floor(share * n)) rows; a row drawn twice stays once."""
    own = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in categories]))
    long = df.select(key, F.explode(own).alias("category"))
    last = _cutoffs(long, F.col("category"), F.greatest(F.lit(1), F.floor(F.col("population") * share)), seed, key).collect()  # a row a category
    kind = df.schema[key].dataType
    drawn = F.lit(False)
    for r in last:
        place = F.struct(F.lit(r["h"]).alias("h"), F.lit(r["key"]).cast(kind).alias("key"))
        drawn = drawn | ((F.col(f"`{r['group']}`") == 1) & (_place(key, seed) <= place))
    return df.where(drawn)


def balanced_sample(df: DataFrame, n: int, seed: int = 42, key: str = "request_id") -> DataFrame:
    """n/2 rows of each label, bounded by the smaller one."""
    least = df.groupBy("label").agg(F.count("*").alias("c")).agg(F.min("c")).first()[0] or 0
    return _first_by_hash(df, "label", F.lit(min(n // 2, least)), seed, key).drop("population")


def hash_split(df: DataFrame, share: float = 0.9, seed: int = 42, key: str = "request_id") -> DataFrame:
    """``part`` train or validation by a hash of the id."""
    bucket = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(bucket < int(share * (1 << 32)), "train").otherwise("validation"))


def every_nth(df: DataFrame, n: int, key: str = "request_id") -> DataFrame:
    """Every n-th row in the order of the id (the n-th, the 2n-th, ...), for observation; ids may have gaps or be text."""
    return metrics.numbered(df, key, "_row").where(F.col("_row") % n == 0).drop("_row")


def head_n(df: DataFrame, n: int, key: str = "request_id") -> DataFrame:
    """The first n rows in the order of the id."""
    return df.orderBy(key).limit(n)


def top_k(df: DataFrame, score: str, k: int, name: str) -> DataFrame:
    """The k highest scores, ties by name."""
    return df.orderBy(F.desc(score), name).limit(k)


def best_run(runs: DataFrame, max_fpr: float, key: str = "run_id", fallback: int = 10) -> DataFrame:
    """H3: largest recall with fpr <= max_fpr, else among the ``fallback`` runs of lowest fpr."""
    all_ = W.partitionBy()
    out = runs.withColumn("_any", F.max((F.col("fpr") <= max_fpr).cast("int")).over(all_)).withColumn("_r", F.row_number().over(W.orderBy("fpr", key)))
    out = out.where(F.when(F.col("_any") == 1, F.col("fpr") <= max_fpr).otherwise(F.col("_r") <= fallback))
    return out.orderBy(F.desc("recall"), "fpr", key).limit(1).drop("_any", "_r")


def union_classes(normal: DataFrame, attack: DataFrame) -> DataFrame:
    """H5: both classes stacked with target 0 and 1."""
    return normal.withColumn("target", F.lit(0)).unionByName(attack.withColumn("target", F.lit(1)))


def token_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """H6: tokens of two runs: ``side`` both, left or right."""
    a, b = left.select("term"), right.select("term")
    return (
        a.intersect(b).withColumn("side", F.lit("both"))
        .unionByName(a.subtract(b).withColumn("side", F.lit("left")))
        .unionByName(b.subtract(a).withColumn("side", F.lit("right")))
    )


def distinct_requests(df: DataFrame) -> DataFrame:
    """H7: one row per request text, the smallest id."""
    return df.groupBy("request").agg(F.min("request_id").alias("request_id"))
