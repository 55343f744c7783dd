"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import WORDS, gram_hashes, texts, word_hashes
from .tables import discard, materialize

#: Bytes of item shingles that one pass over the documents carries to every task.
PASS_BYTES = 32_000_000


def _need(n: int, percent: int) -> int:
    """Shared shingles that make an item of n shingles contained."""
    return -(-n * percent // 100)


@dataclass
class Partition:
    """Items whose number of shingles lies in (upper / 2, upper], all of one gram length.

    The sketch of an item is its ``k`` smallest hashes (its bottom-k MinHash).  A document that
    contains the item misses at most n - need shingles, and n - need is largest for the upper
    size, so k = upper - need(upper) + 1 hashes always share one with it: candidates are complete.
    """

    words: int
    upper: int
    least: int
    sketch: np.ndarray
    owner: np.ndarray


class ItemIndex:
    """Sketches by size partition, and the exact sets they are verified with."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int, words: int = WORDS):
        self.percent, self.ids, self.sets, sizes, lens = percent, [], [], [], []
        for item_id, text in items:
            w = word_hashes(np.frombuffer(text, np.uint8))
            if len(w):
                g = np.unique(gram_hashes(w, min(words, len(w))))
                self.ids.append(item_id)
                self.sets.append(g)
                sizes.append(len(g))
                lens.append(min(words, len(w)))
        self.parts = []
        for key in sorted({(m, 1 << (s - 1).bit_length()) for s, m in zip(sizes, lens, strict=True)}):
            own = [i for i, (s, m) in enumerate(zip(sizes, lens, strict=True)) if (m, 1 << (s - 1).bit_length()) == key]
            upper = max(sizes[i] for i in own)
            k = upper - _need(upper, percent) + 1
            sketch = np.concatenate([self.sets[i][:k] for i in own])
            owner = np.concatenate([np.full(min(k, sizes[i]), i) for i in own])
            order = np.argsort(sketch, kind="stable")
            least = min(_need(sizes[i], percent) for i in own)
            self.parts.append(Partition(key[0], upper, least, sketch[order], owner[order]))

    def search(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(item position, shared shingles, item shingles) of all items contained in a text."""
        words = word_hashes(data)
        grams: dict[int, np.ndarray] = {}
        out = []
        for part in self.parts:
            if part.words not in grams:
                grams[part.words] = gram_hashes(words, part.words)
            mine = grams[part.words]
            if len(mine) < part.least:  # too short a document for this size partition
                continue
            at = np.searchsorted(part.sketch, mine)
            at[at == len(part.sketch)] = 0
            hit = np.unique(mine[part.sketch[at] == mine])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(part.sketch, hit), np.searchsorted(part.sketch, hit, side="right")
            found = np.unique(np.concatenate([part.owner[a:b] for a, b in zip(lo, hi, strict=True)]))
            whole = np.unique(mine)
            for i in found.tolist():
                at = np.searchsorted(whole, self.sets[i])
                at[at == len(whole)] = 0
                shared = int((whole[at] == self.sets[i]).sum())
                if shared >= _need(len(self.sets[i]), self.percent):
                    out.append((i, shared, len(self.sets[i])))
        return out


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in portions of at most about PASS_BYTES of shingles (or one item)."""
    held, size = [], 0
    for r in benchmark.selectExpr("cast(item_id as long) item_id", "text").where("text is not null").toLocalIterator():
        data = r["text"].encode()
        cost = 8 * (len(data) // 2 + 1)
        if held and size + cost > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((r["item_id"], data))
        size += cost
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """All pairs of a document and a benchmark item contained in it: ``doc_id, item_id, shared, n_item, containment``.

    An item is contained if at least ``percent`` of its distinct five-word shingles (ASCII
    letters in either case, words between space and U+0009..U+000D) occur in the document; an
    item of fewer words is one shingle, its whole sequence of words.  Shingles are compared as
    64-bit hashes.  Items go to all tasks in portions of bounded size, one pass over the
    documents each, whose result is written before the next portion is built; documents are not
    shuffled.  Null and empty texts and items match nothing; ids may be null or repeated; an
    item text under several ids is found under each; further columns are ignored; very long texts
    are searched whole; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    schema = "doc_id long, item_id long, shared long, n_item long, containment double"
    out = None
    for portion in _passes(benchmark):
        index = spark.sparkContext.broadcast(ItemIndex(portion, percent))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                found = [(j, *hit) for j, data in enumerate(texts(batch.column(1))) for hit in items.search(data)]
                j, i, shared, n = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ([],) * 4))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(j)),
                        pa.array([items.ids[x] for x in i], pa.int64()),
                        pa.array(shared),
                        pa.array(n),
                        pa.array(shared / n if len(n) else np.empty(0)),
                    ],
                    names=["doc_id", "item_id", "shared", "n_item", "containment"],
                )

        part = materialize(rows.mapInArrow(run, schema), "contained")
        index.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Documents without any contained item, columns unchanged.

    The test runs beside each row, so rows need no key and nothing is joined back.  Each portion
    of items works on what the one before it left.
    """
    spark, last = docs.sparkSession, None
    for portion in _passes(benchmark):
        index = spark.sparkContext.broadcast(ItemIndex(portion, percent))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("text")
                yield batch.filter(pa.array([not index.value.search(data) for data in texts(batch.column(at))], pa.bool_()))

        docs = materialize(docs.mapInArrow(run, docs.schema), "clean")
        index.destroy()
        if last is not None:
            discard(last)
        last = docs
    return docs
