"""Sharding by a Feistel permutation of global row numbers (native expressions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import materialize

ROUNDS = 6
WALK = 8


def _step(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the alternating Feistel network over Z_a x Z_b; a bijection of [0, a*b)."""
    left, right = F.floor(x / F.lit(b)) if b > 1 else x, (x % F.lit(b))
    left = left.cast("long")
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(r), F.lit(seed)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(r), F.lit(seed)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def _step_back(x: Column, a: int, b: int, seed: int) -> Column:
    """Inverse of :func:`_step`."""
    left, right = F.floor(x / F.lit(b)).cast("long") if b > 1 else x, (x % F.lit(b))
    for r in reversed(range(ROUNDS)):
        if r % 2 == 0:
            left = F.pmod(left - F.pmod(F.xxhash64(right, F.lit(r), F.lit(seed)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right - F.pmod(F.xxhash64(left, F.lit(r), F.lit(seed)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _walk(x: Column, n: int, seed: int, step) -> Column:
    """Cycle walking: repeat the permutation of [0, a*b) until the value is below n.

    At most ``a*b - n`` (< sqrt(n) + 1) values lie outside, and a walk visits each at most
    once, so ``a*b - n + 1`` steps always suffice.  Values still outside after ``WALK``
    further steps (chance about n ** (-WALK / 2)) get the full bound.
    """
    a, b = _sides(n)

    def more(start: Column, steps: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            start,
            lambda acc, _: F.when(acc < F.lit(n), acc).otherwise(step(acc, a, b, seed)),
        )

    first = step(x.cast("long"), a, b, seed)
    outside = a * b - n
    if outside == 0:
        return first
    short = more(first, min(WALK, outside))
    full = short if outside <= WALK else F.when(short < F.lit(n), short).otherwise(more(short, outside))
    return F.when(first < F.lit(n), first).otherwise(full)


def permute(row: Column, n: int, seed: int = 17) -> Column:
    """Position of row number ``row`` (0..n-1) in the shuffle; a bijection of [0, n)."""
    return _walk(row, n, seed, _step)


def unpermute(position: Column, n: int, seed: int = 17) -> Column:
    """Row number at a shuffled position."""
    return _walk(position, n, seed, _step_back)


def locate(row: Column, n: int, shards: int, seed: int = 17) -> tuple[Column, Column]:
    """(shard, slot) of a row number, computed without reading any other row."""
    p = permute(row, n, seed)
    return (p % F.lit(shards)).cast("int"), F.floor(p / F.lit(shards)).cast("long")


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 17) -> Column:
    """Row number stored at (shard, slot)."""
    return unpermute(slot.cast("long") * F.lit(shards) + shard, n, seed)


#: Distinct rows that one window partition numbers, about.
BUCKET = 500_000


def number_rows(rows: DataFrame, keys: list[str], least: int = 256) -> tuple[DataFrame, int]:
    """Give every row a global number 0..n-1 that depends on the rows' contents alone.

    Rows are grouped by ``keys`` with a map-side combine, so a row repeated any number of
    times travels as one count.  Distinct rows are dealt to hash buckets, numbered inside a
    bucket by a window, and shifted by the sum of earlier buckets (one row per bucket).  The
    number of buckets, ``least`` or more, follows the number of distinct rows.  Equal rows are interchangeable: they get the consecutive numbers of their group.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("m"))
    counted = materialize(counted, "numbered")
    buckets = max(least, -(-counted.count() // BUCKET))
    counted = counted.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    per = counted.groupBy("bucket").agg(F.sum("m").alias("rows"))
    offsets = per.select(
        "bucket", (F.sum("rows").over(W.orderBy("bucket")) - F.col("rows")).alias("before")
    )  # one row a bucket
    n = per.agg(F.sum("rows")).first()[0] or 0
    w = W.partitionBy("bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    placed = counted.withColumn("start", F.sum("m").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("m"))
    placed = placed.join(offsets, "bucket").withColumn("start", F.col("start") + F.col("before"))
    chunk = 4096
    placed = placed.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / chunk))))
    last = F.least(F.lit(chunk).cast("long"), F.col("m") - F.col("c") * chunk) - 1
    placed = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return placed.select(*keys, (F.col("start") + F.col("c") * chunk + F.col("i")).alias("row")), n


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """Deal documents to ``shards`` by a Feistel permutation of their global row numbers.

    Law ``rows``: shard sizes differ by one at most; slots of a shard run from 0 without gaps.
    Null text counts as empty (size 8, checksum 0); null or repeated doc_ids and repeated rows
    are rows like others; an empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"])
    shard, slot = locate(F.col("row"), max(n, 1), shards, seed)
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.alias("shard"),
        slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("row"),
    )
