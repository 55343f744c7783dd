"""SimHash near-duplicates through segment popcounts on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import fmix, texts
from .tables import connected_components, materialize, roots

WORDS = 3
SEED = 42
#: Shingles hashed at once; longer texts go by portions.
PORTION = 65_536
#: Bits of one segment: its popcount is a coordinate.
SEGMENT = 2
#: Members of a cell above which it gets a finer grid.
CROWDED = 4_096
#: Rows and columns of one block of comparisons.
TILE = 1_024

_PAIRS = np.uint64(0x5555555555555555)


def simhash(data: bytes) -> int:
    """The 64-bit fingerprint of one text: bit by bit, the majority of its shingles' hashes."""
    words = data.lower().split()
    if not words:
        return 0
    n = min(WORDS, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), PORTION):
        cut = zip(starts[i : i + PORTION].tolist(), ends[i : i + PORTION].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in cut], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row; the fingerprint is a signed long, zero without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(d.tobytes()) for d in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the 32 segments, each in its own two bits; the lower 16 segments are the lower 32 bits."""
    return (fp & _PAIRS) + ((fp >> np.uint64(1)) & _PAIRS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embeddings; never above the Hamming distance of the fingerprints.

    In two bits |x - y| is what the differing bits say, but for 01 and 10, which differ by one.
    """
    x = a ^ b
    low, high = x & _PAIRS, (x >> np.uint64(1)) & _PAIRS
    # 00/01, 01/00: 1.  00/10, 10/00: 2.  01/10, 10/01 (both bits differ): 1.
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low).astype(np.int64)


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Exact links of arrays that are broadcast against each other; the Manhattan distance of the embeddings goes first."""
    ok = manhattan(embed(a), embed(b)) <= distance
    return ok & (np.bitwise_count(a ^ b) <= distance)


def _enter(fp: np.ndarray, key: np.ndarray, shift: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Grid entries of points under the cell ``key`` that they share: _ENTRY.

    The ``bits`` bits of the embedding from ``shift`` on are halved.  Points at most 3 apart there are
    at most 1 apart in one half: their counts in it are equal, or differ by one in one coordinate.
    So a point is at home in the cell of its counts and visits those with one count lowered by
    one; the other half is what a finer grid would look at next.
    """
    half = bits // 2
    e = embed(fp)
    for k in range(2):
        at, rest = shift + k * half, shift + (1 - k) * half
        cell = (e >> np.uint64(at)) & np.uint64((1 << half) - 1)
        mixed = fmix(key + np.uint64(at + 64 * half))
        for s in (None, *range(0, half, SEGMENT)):
            own = slice(None) if s is None else np.flatnonzero((cell >> np.uint64(s)) & np.uint64(3))
            where = cell[own] if s is None else cell[own] - np.uint64(1 << s)
            keys = fmix(mixed[own] ^ fmix(where + np.uint64(1)))
            n = len(keys)
            cols = [pa.array(keys.view(np.int64)), pa.array(fp[own].view(np.int64)), pa.array(np.full(n, s is None)), pa.array(np.full(n, rest, np.int8)), pa.array(np.full(n, half, np.int8))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "fp", "home", "shift", "bits"])


_ENTRY = "key long, fp long, home boolean, shift byte, bits byte"


def _grid(points: DataFrame) -> DataFrame:
    """Entries of the coarse grid over the whole embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            yield from _enter(fp, np.zeros(len(fp), np.uint64), 0, 64)

    return points.select("fp").mapInArrow(run, _ENTRY)


def _finer(crowded: DataFrame) -> DataFrame:
    """Entries of crowded cells on the grid over the part of the embedding that their cells say nothing of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, shift, bits = (batch.column(c).to_numpy() for c in range(4))
            for at, size in sorted(set(zip(shift.tolist(), bits.tolist(), strict=True))):
                own = (shift == at) & (bits == size)
                yield from _enter(fp[own].view(np.uint64), key[own].view(np.uint64), at, size)

    return crowded.selectExpr("b key", "a fp", "shift", "bits").mapInArrow(run, _ENTRY)


class Cells:
    """Links of the members of cells that come one after the other, contracted before they are sent."""

    def __init__(self, distance: int):
        self.distance, self.a, self.b, self.size = distance, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.size += len(a)
            if self.size > TILE * TILE:
                self.settle()

    def settle(self) -> None:
        nodes, root = roots(np.concatenate(self.a).view(np.int64), np.concatenate(self.b).view(np.int64))
        more = nodes != root
        self.a, self.b = [nodes[more].view(np.uint64)], [root[more].view(np.uint64)]
        self.size = 0  # counts what comes new

    def small(self, key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> None:
        """Cells of few members, all at once: each member meets those 1, 2, ... places further on."""
        for k in range(1, len(key)):
            same = key[k:] == key[:-k]
            if not same.any():
                break
            at = np.flatnonzero(same & (home[k:] | home[:-k]))
            at = at[_close(fp[at], fp[at + k], self.distance)]
            self.add(fp[at], fp[at + k])

    def large(self, fp: np.ndarray, home: np.ndarray) -> None:
        """One cell, by blocks of comparisons; in the order of popcounts, those too far apart are passed over."""
        order = np.argsort(np.bitwise_count(fp), kind="stable")
        fp, ones, own = fp[order], np.bitwise_count(fp)[order].astype(np.int64), home[order]
        left, low = fp[own], ones[own]
        for i in range(0, len(left), TILE):
            x = left[i : i + TILE]
            a, b = np.searchsorted(ones, low[i] - self.distance), np.searchsorted(ones, low[i : i + TILE][-1] + self.distance, side="right")
            for j in range(a, b, TILE):
                y = fp[j : min(j + TILE, b)]
                r, c = np.nonzero(_close(x[:, None], y[None, :], self.distance))
                self.add(x[r], y[c])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if self.a:
            self.settle()
            return self.a[0], self.b[0]
        return np.empty(0, np.uint64), np.empty(0, np.uint64)


#: Members of a cell up to which cells are compared all at once.
FEW = 48
_FOUND = "a long, b long, shift byte, bits byte"


def _meet(entries: DataFrame, distance: int, crowded: int) -> DataFrame:
    """Links ``a, b`` between members of a cell (shift null), and the members of crowded cells, ``a`` with the cell's key ``b``.

    Members come in the order of cells.  A crowded cell is passed on as it comes, so a task holds no
    more than ``crowded`` members of it; on the finest grid a cell is held whole, eight bytes a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(distance)
        names = ["a", "b", "shift", "bits"]

        def passed(key, fp, shift, bits) -> pa.RecordBatch:
            cols = [pa.array(fp.view(np.int64)), pa.array(key.view(np.int64)), pa.array(shift), pa.array(bits)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def settle(cols: list[np.ndarray], over) -> Iterator[pa.RecordBatch]:
            """Whole cells; ``over`` is the key of the cell that is passed on already."""
            key, fp, home, shift, bits = cols
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            few = np.repeat((size > 1) & (size <= FEW), size)
            cells.small(key[few], fp[few], home[few])
            for a, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
                own = slice(a, a + n)
                if bits[a] > 2 * SEGMENT and (n > crowded or key[a] == over):
                    yield passed(*(c[own] for c in (key, fp, shift, bits)))
                else:
                    cells.large(fp[own], home[own])
            if over is not None and len(key) and key[0] == over and size[0] <= FEW and bits[0] > 2 * SEGMENT:
                yield passed(*(c[: size[0]] for c in (key, fp, shift, bits)))

        held, over = None, None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            cols[0], cols[1] = cols[0].view(np.uint64), cols[1].view(np.uint64)
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
            key = cols[0]
            last = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1])) if len(key) else 0
            if last:
                yield from settle([c[:last] for c in cols], over)
                over = None
            held = [c[last:] for c in cols]
            if len(held[0]) > crowded and held[4][0] > 2 * SEGMENT:
                over = held[0][0]
                yield passed(held[0], held[1], held[3], held[4])
                held = [c[:0] for c in held]
        if held is not None:
            yield from settle(held, over)
        a, b = cells.links()
        none = pa.nulls(len(a), pa.int8())
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], names=names)

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def links(points: DataFrame, distance: int = 3, crowded: int = CROWDED) -> DataFrame:
    """Links ``a, b`` that join the distinct fingerprints ``fp`` just as all links at most ``distance`` (up to 3) apart do.

    A range join on the grid of segment popcounts: entries meet cell by cell, the Manhattan
    distance of the embeddings is a lower bound, and the Hamming distance decides.  Cells with
    more than ``crowded`` members get a finer grid, three times at most.
    """
    if distance > 3:
        raise ValueError("the grid is complete up to 3 differing bits")
    entries, out = _grid(points), None
    for _ in range(4):
        found = materialize(_meet(entries, distance, crowded), "cells")
        got = found.where("shift IS NULL").select("a", "b")
        out = got if out is None else out.unionByName(got)
        rest = found.where("shift IS NOT NULL")
        if rest.isEmpty():
            return out
        entries = _finer(rest)
    raise RuntimeError("the finest grid passes nothing on")


def simhash_classes(docs: DataFrame, distance: int = 3, crowded: int = CROWDED) -> DataFrame:
    """Classes of documents whose fingerprints link: ``doc_id, fingerprint, component_id``.

    The fingerprint of a text has a bit set where more than half of its three-word shingles'
    hashes (XXH64, seed 42; repeats count; a shorter text is one shingle) have it; A-Z count as
    a-z, words end at space and U+0009..U+000D.  Texts without a word, null ones included, have
    fingerprint zero, which links like any other.  Rows of one fingerprint are one point; points
    link at ``distance`` bits or fewer, and classes are named by their smallest doc_id.

    A doc_id may be null (never a smallest id, unless all of a class are) or repeated; further
    columns are ignored; very long texts are hashed in portions; an empty table gives no rows.
    """
    mine = materialize(fingerprints(docs), "fingerprints")
    points = materialize(mine.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    tied = connected_components(links(points, distance, crowded))
    tied = materialize(tied.join(points.hint("merge"), F.col("node") == F.col("fp")).select("fp", "component", "least"), "tied")
    # written, so that the joins read both sides through exchanges and a hot component or fingerprint can be split
    low = materialize(tied.groupBy("component").agg(F.min("least").alias("component_id")), "low")
    named = tied.join(low.hint("merge"), "component").select("fp", "component_id")
    named = materialize(points.join(named.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    out = mine.join(named.hint("merge"), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
