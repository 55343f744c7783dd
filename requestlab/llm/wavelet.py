"""Token ids of whole texts in wavelet matrices, one per shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import materialize
from .tokens import encoder, prove_whole_tokens

#: Bits between two entries of the rank directory.
BLOCK = 512
MAGIC = b"RLWM0001"
#: Ids in a shard: little enough for a level to stay in the processor's cache.
SHARD = 1 << 20


class WaveletMatrix:
    """Succinct sequence of integers: one bit-plane a level with a rank directory.

    File layout, little-endian: magic, n (u64), levels (u32), zeros per level (u64 each), then
    for each level the rank directory (u32 ones before each ``BLOCK`` bits) and the plane.
    """

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks
        self.levels = len(planes)

    @classmethod
    def build(cls, values: np.ndarray, levels: int = 16) -> WaveletMatrix:
        cur, zeros, planes, ranks = values.astype(np.uint16, copy=False), [], [], []
        for level in range(levels):
            bits = (cur & np.uint16(1 << (levels - 1 - level))) != 0
            low, high = np.compress(~bits, cur), np.compress(bits, cur)
            plane = np.packbits(bits, bitorder="little")
            padded = np.zeros(-(-len(bits) // BLOCK) * BLOCK // 8, np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]))
            planes.append(padded)
            zeros.append(len(low))
            cur = np.concatenate([low, high])
        return cls(len(values), zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        head = MAGIC + np.array([self.n], "<u8").tobytes() + np.array([self.levels], "<u4").tobytes()
        body = [np.array(self.zeros, "<u8").tobytes()]
        for rank, plane in zip(self.ranks, self.planes, strict=True):
            body += [rank.astype("<u4").tobytes(), plane.tobytes()]
        return head + b"".join(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, levels = int(np.frombuffer(data, "<u8", 1, 8)[0]), int(np.frombuffer(data, "<u4", 1, 16)[0])
        zeros = np.frombuffer(data, "<u8", levels, 20).tolist()
        at, blocks = 20 + 8 * levels, -(-n // BLOCK)
        planes, ranks = [], []
        for _ in range(levels):
            ranks.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
            planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8
        return cls(n, zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : -(-i // 8)]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())
        return ones - int(part[-1] >> (i & 7)).bit_count() if i & 7 and len(part) else ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a level."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The value at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, i: int | None = None) -> int:
        """Occurrences of a value among the first i positions (all, if not given)."""
        lo, hi = self._range(value, self.n if i is None else i)
        return hi - lo

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a value."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def to_array(self) -> np.ndarray:
        """All values, decoded plane by plane from the last to the first."""
        cur = np.zeros(self.n, np.uint16)
        for level in reversed(range(self.levels)):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, out = self.zeros[level], np.empty(self.n, np.uint16)
            out[~bits] = cur[:z]
            out[bits] = cur[z:] | np.uint16(1 << (self.levels - 1 - level))
            cur = out
        return cur


def write_shards(docs: DataFrame, path: str, end_id: int = 1, shard_ids: int = SHARD) -> DataFrame:
    """Encode texts, in ascending doc_id order, into wavelet-matrix files; returns the table of files.

    Texts are range-partitioned and sorted by doc_id (nulls first, ties by text); a partition is
    cut into shards of about ``shard_ids`` ids at document ends.  A shard is one row of the
    written table, with its documents' ids and lengths and its file as ``payload``: Spark's
    committed writer works on any store and drops what lost tasks left behind.
    """
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, proven.value, False)
        at, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        held = inside = 0

        def shard() -> pa.RecordBatch:
            values = np.concatenate(parts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([inside], pa.int64()),
                    pa.array([len(values)], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([WaveletMatrix.build(values).to_bytes()], pa.binary()),
                ],
                names=["part", "seq", "inside", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            names, done = batch.column(0).to_pylist(), True
            for ids, rows, counts, closed in enc.encode(batch.column(1), end_id):
                used = upto = 0
                for row, count, last in zip(rows.tolist(), counts.tolist(), closed.tolist(), strict=True):
                    if done:
                        keys.append(names[row])
                        lengths.append(0)
                    lengths[-1] += count
                    upto, held, done = upto + count, held + count, last
                    if held >= shard_ids and done:
                        parts.append(ids[used:upto])
                        yield shard()
                        seq, inside, held, used = seq + 1, inside + held, 0, upto
                        keys, lengths, parts = [], [], []
                parts.append(ids[used:])
        if keys:
            yield shard()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    # rows that share an id, or have none, are dealt by the beginning of their text
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 256)).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    shards = rows.mapInArrow(
        run, "part int, seq int, inside long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    )
    return materialize(shards, "wavelet")


def read_shards(files: DataFrame) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` for every document.

    A shard knows its place in its partition; what lies in earlier partitions is a sum over
    one row a partition, whose number is set when writing (spark.sql.shuffle.partitions).
    """
    per = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = per.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("before"))
    rows = files.join(F.broadcast(before), "part").withColumn("first", F.col("before") + F.col("inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, lengths, payload, first = (batch.column(c)[i].as_py() for c in range(4))
                values = WaveletMatrix.from_bytes(payload).to_array()
                ends = np.cumsum(np.asarray(lengths, np.int64))
                starts_ = ends - np.asarray(lengths, np.int64)
                crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(starts_, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(starts_ + first, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = rows.select("doc_ids", "lengths", "payload", "first")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write and read back the ids of all texts.

    Null text is empty (only the end id); null doc_ids come first; repeated rows are rows of
    their own, next to each other; an empty table gives no rows; further columns are ignored.
    """
    return read_shards(write_shards(docs, path, end_id))
