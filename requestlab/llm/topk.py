"""Exact top-k inner products by no-random-access aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import materialize

BLOCK_ROWS = 4096
BLOCK_QUERIES = 8192
#: Entries of one list that are read at once, as a share of the list.
PORTION = 1 / 32
#: Shares of all entries after which the bounds are looked at.
LOOKS = (0.375, 0.5, *(x / 16 for x in range(9, 16)), 31 / 32)
LOWEST = -(1 << 62)


class SortedLists:
    """A block of candidates with the list of every dimension sorted by value (ascending, ties by id)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        places = np.argsort(self.vectors, axis=0, kind="stable")
        self.places = np.ascontiguousarray(places.T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.vectors, places, axis=0).T)
        self.floats = self.values.astype(np.float64)
        self.slots = self.places * self.vectors.shape[1] + np.arange(self.vectors.shape[1])[:, None]  # (row, list) of an entry as one number
        n = len(ids)
        self.cuts = np.unique(np.append(np.arange(0, n, max(1, int(n * PORTION))), n))
        # what an unread entry can be at most when a portion was read, from the high and from the low end
        self.high = np.concatenate([self.values[:, n - 1 - self.cuts[1:-1]], self.values[:, :1]], axis=1)
        self.low = np.concatenate([self.values[:, self.cuts[1:-1]], self.values[:, -1:]], axis=1)

    def _order(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Portions in reading order, (list, portion): those first by which the best unread score falls fastest.

        A list is read in sequence, so a portion is no more urgent than the ones before it.
        """
        up = query[:, None] > 0
        top = np.concatenate([np.where(up, self.values[:, -1:], self.values[:, :1]), np.where(up, self.high, self.low)], axis=1) * query[:, None]
        gain = (top[:, :-1] - top[:, 1:]) / np.diff(self.cuts)
        urgent = np.minimum.accumulate(gain, axis=1)
        parts = urgent.shape[1]
        at = np.argsort(-urgent.ravel(), kind="stable")
        return at // parts, at % parts

    def top(self, query: np.ndarray, k: int, own: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """A query's k best of the block: (positions, scores, entries read), ties to the smaller id.

        Lists are read sequentially from their good end (high values for a positive weight, low
        ones for a negative), the steepest first.  A candidate's score is at least what was read
        of it with the worst entry of each list where it was not seen, and at most that with the
        entry the list stands at.  Reading stops when few candidates are left that can reach the
        k-th lower bound, or ``floor``, which k candidates elsewhere reach; what is left is
        resolved to final scores.  Ties with the bound stay in.  ``own`` are rows that take no part.
        """
        n, d = len(self.ids), len(query)
        exact = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(query).sum()) < 2**50
        kind = np.float64 if exact else np.int64  # doubles are exact while every sum stays below 2^53
        high, weight, values = query > 0, query.astype(kind), self.floats if exact else self.values
        worst = np.where(high, self.values[:, 0], self.values[:, -1]) * weight
        lower = np.full(n, worst.sum())
        seen = np.zeros((n, d), kind)
        flags = seen.ravel()
        alive = np.ones(n, bool)
        alive[own] = False
        left = np.flatnonzero(alive)
        read, few = 0, max(4 * k, n // 64)
        lists, parts = self._order(query) if len(left) > few else (np.empty(0, int), np.empty(0, int))
        done = np.zeros(d, np.int64)  # portions read of each list
        for share in LOOKS if len(lists) else ():
            upto = np.bincount(lists[: int(len(lists) * share)], minlength=d)
            more = np.flatnonzero(upto > done)
            begin, end = self.cuts[done[more]], self.cuts[upto[more]]
            begin, end = np.where(high[more], n - end, begin), np.where(high[more], n - begin, end)  # places in the lists
            ranges = list(zip(more.tolist(), begin.tolist(), end.tolist(), strict=True))
            rows = np.concatenate([self.places[j, x:y] for j, x, y in ranges])
            add = np.concatenate([values[j, x:y] * w - v for (j, x, y), w, v in zip(ranges, weight[more].tolist(), worst[more].tolist(), strict=True)])
            if exact:
                lower += np.bincount(rows, add, minlength=n)
            else:
                np.add.at(lower, rows, add)
            flags[np.concatenate([self.slots[j, x:y] for j, x, y in ranges])] = 1
            read, done = read + len(rows), upto
            # the best entry that a list still holds
            slack = np.where(high, self.high[np.arange(d), upto - 1], self.low[np.arange(d), upto - 1]) * weight
            slack = np.where(upto == 0, np.where(high, self.values[:, -1], self.values[:, 0]) * weight, slack) - worst
            bar = floor
            if len(left) >= k:
                some = lower[left]
                bar = max(bar, int(np.partition(some, len(some) - k)[len(some) - k]))
            unread = slack.sum() - ((seen @ slack)[left] if 2 * len(left) > n else seen[left] @ slack)
            left = left[lower[left] + unread >= bar]
            if len(left) <= few:
                break
        score = self.vectors[left] @ query
        first = np.lexsort((self.ids[left], -score))[:k]
        return left[first], score[first], read


def _quantise(cell: str) -> tuple:
    v = F.col(cell)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return good, F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def search(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k best of each query in each group of blocks: ``query_id, query, vec_id, score, read, entries``.

    ``read`` of ``entries`` list entries were read.  See :func:`top_k`.
    """
    good, ints = _quantise(vec_col)
    rows = vectors.where(F.col(id_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"), ints.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    # of a row that occurs more than k times no more than k can be among the k best
    rows = rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("c"), F.max("q").alias("q"))
    rows = materialize(rows, "vectors")
    n, nq = rows.agg(F.sum("c"), F.count_if("q")).first()
    spark = vectors.sparkSession
    cb, tiles = max(1, -(-(n or 0) // block_rows)), max(1, -(-(nq or 0) // block_queries))
    # as many groups of blocks as give every core something to do; within a group bounds carry over
    groups = min(cb, max(1, -(-spark.sparkContext.defaultParallelism // tiles)))
    cell = F.collect_list(F.struct("id", "v", "c")).alias("rows")
    tile = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(tiles)).cast("int").alias("tile")
    queries = rows.where("q").groupBy(tile).agg(cell).select("tile", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(-1).alias("cb"), "rows")
    blocks = rows.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(cb)).cast("int").alias("cb")).agg(cell)
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), (F.col("cb") % groups).alias("grp"), "cb", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries = None, None  # the tile of queries at hand, with the k best ids and scores of each so far

        def out() -> pa.RecordBatch:
            qid, _, ids, scores, read, entries = queries
            size = [len(x) for x in ids]
            cols = [np.repeat(qid, size), np.repeat(np.arange(len(qid)) + (now[0] << 32), size), *(np.concatenate([np.empty(0, np.int64), *c]) for c in (ids, scores))]
            cols += [np.repeat(c, size) for c in (read, entries)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "query", "vec_id", "score", "read", "entries"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("tile")[i].as_py(), batch.column("grp")[i].as_py()
                ids, mat, copies = unpack(batch.column("rows"), i)
                if batch.column("cb")[i].as_py() < 0:
                    if queries is not None:
                        yield out()
                    order = np.lexsort((*mat.T[::-1], ids))  # the same numbers in every group
                    none = [np.empty(0, np.int64)] * len(ids)
                    now, queries = key, (ids[order], mat[order], list(none), list(none), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64))
                elif key == now:
                    qid, qmat, found, scores, read, entries = queries
                    width = max(mat.shape[1], qmat.shape[1])
                    mat, qs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (mat, qmat))
                    lists = SortedLists(np.repeat(ids, copies), np.repeat(mat, copies, axis=0))
                    lo, hi = np.searchsorted(lists.ids, qid), np.searchsorted(lists.ids, qid, side="right")
                    for q in range(len(qid)):
                        floor = int(scores[q][-1]) if len(scores[q]) == k else LOWEST
                        pos, s, r = lists.top(qs[q], k, np.arange(lo[q], hi[q]), floor)
                        both, every = np.concatenate([found[q], lists.ids[pos]]), np.concatenate([scores[q], s])
                        first = np.lexsort((both, -every))[:k]
                        found[q], scores[q] = both[first], every[first]
                        read[q] += r
                        entries[q] += lists.values.size
        if queries is not None:
            yield out()

    # a task takes a tile of queries through the blocks of a group, so later blocks stop at what earlier ones reached
    meet = queries.unionByName(blocks).repartition("tile", "grp").sortWithinPartitions("tile", "grp", "cb")
    return meet.mapInArrow(run, "query_id long, query long, vec_id long, score long, read long, entries long")


def top_k(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Each query's k highest integer inner products over all other rows: ``query_id, rank, vec_id, score``.

    Components become floor(256 x).  Rows whose id or vector is null, or whose vector is empty or
    holds null or non-finite components, take no part.  Shorter vectors count as padded with
    zeros.  Queries are the rows for which ``is_query`` holds; rows equal in id and vector are one
    query and as many candidates as there are (more than k of them cannot rank); different
    vectors of one id are queries of their own; a query never meets rows of its own id.  Blocks of
    candidates go to every tile of queries, a tile to every group of blocks; a task keeps k rows a
    query, and a window merges the groups.  Scores must fit 64 bits.
    """
    found = search(vectors, is_query, id_col, vec_col, k, block_rows, block_queries)
    rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def unpack(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, (zero-padded) integer vectors and copies of one block."""
    cell = column[i].values
    ids, copies = (cell.field(c).to_numpy(zero_copy_only=False) for c in ("id", "c"))
    lists = cell.field("v")
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return ids, flat.reshape(len(lengths), -1), copies
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return ids, out, copies
