"""Written tables in the shared folder, and connected components on Spark."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestlab.sources.store import remove, shared_dir


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    This cuts lineage: a lost executor makes later stages reread files, not recompute.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later job reads."""
    for df in written:
        if path := _paths.pop(df, None):
            remove(df.sparkSession, path)


#: Edges that one task contracts at once; a smaller graph is finished by one task, a larger one in rounds.
EDGES = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the edges a-b: labels go down along edges and halve their paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[label]


def _contract(edges: DataFrame) -> DataFrame:
    """The edges of every task as stars ``a, b`` (b the smallest of its nodes), at most EDGES at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            nodes, root = roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
            more = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(root[more])], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
            size += batch.num_rows
            if size >= EDGES:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for each id that has an edge: ``(node, component)``.

    ``edges`` has long columns ``a`` and ``b``.  Tasks first contract their own edges to stars.
    While more than ``EDGES`` stars are left, large-star / small-star rounds (Kiveris et al. 2014)
    go on: two aggregations with map-side combine and two equi-joins, whose skew AQE can
    split, each round written to the shared folder.  What is left of bounded size is settled in
    one task.  No edges give no rows.  Raises if ``max_rounds`` do not suffice (they grow as log n).
    """
    cur = materialize(_contract(edges.where("a <> b")), "cc")
    before = None
    for _ in range(max_rounds):
        last = cur
        if cur.count() <= EDGES:
            cur = materialize(_contract(cur.repartition(1)), "cc")
            discard(last)
            break
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select("a", F.col("m").alias("b"))
        )
        cur = materialize(small.where("a <> b").distinct(), "cc")
        discard(last)
        state = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
