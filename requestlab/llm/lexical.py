"""Ranked lexical search by one Aho-Corasick scan of the documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import spread, texts
from .tables import discard, materialize

#: Characters of item terms, and items, that one pass over the documents carries to every task.
PASS_CHARS, PASS_ITEMS = 4_000_000, 20_000
#: Cells of a block of scores (documents by items).
BLOCK = 2_000_000
#: Characters of text after which a block is scored, however few documents it has.
BLOCK_CHARS = 8_000_000

#: Between terms: bytes below 0x80 other than digits and letters.  A-Z count as a-z.
_GUARD = np.full(256, 0x20, np.uint8)
_GUARD[0x30:0x3A], _GUARD[0x61:0x7B], _GUARD[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_GUARD[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE = _GUARD.tobytes()


def guarded(data: bytes) -> str:
    """A text with a space for every character that is in no term, one before and one after it."""
    return f" {data.translate(_TABLE).decode()} "


def n_terms(data: bytes) -> int:
    """Maximal runs of term characters."""
    if not data:
        return 0
    inside = np.frombuffer(data.translate(_TABLE), np.uint8) != 0x20
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def term_sets(items: DataFrame) -> DataFrame:
    """Distinct items with a term: ``item_id, terms`` (sorted, once each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted(set(guarded(d.tobytes()).split(" ")) - {""}) for d in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.string()))], names=["item_id", "terms"])

    got = items.selectExpr("cast(item_id as long) item_id", "text").where("text IS NOT NULL")
    return got.mapInArrow(run, "item_id long, terms array<string>").where("size(terms) > 0").distinct()


class Items:
    """The items of one pass: their terms, and for each term the items that have it."""

    def __init__(self, ids: list[int | None], terms: list[list[str]]):
        self.ids = pa.array(ids, pa.int64())
        self.terms = sorted(set().union(*terms)) if terms else []
        place = {t: k for k, t in enumerate(self.terms)}
        at = np.array([place[t] for ts in terms for t in ts], np.int64)
        item = np.repeat(np.arange(len(terms)), [len(ts) for ts in terms])
        order = np.argsort(at, kind="stable")
        self.items = item[order].astype(np.int32)
        self.start = np.searchsorted(at[order], np.arange(len(self.terms) + 1))

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """The automaton of the terms, each between guards; a worker builds it when it first asks."""
        made = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            made.add_word(f" {t} ", k)
        made.make_automaton()
        return made


def occurrences(found: ahocorasick.Automaton, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Terms that occur in a text, ascending, and how often."""
    return np.unique(np.fromiter((k for _, k in found.iter(guarded(data))), np.int64), return_counts=True)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([n_terms(d.tobytes()) for d in texts(batch.column(0))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(n)]), pa.array([n.sum()])], names=["docs", "terms"])

    got = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def document_frequency(docs: DataFrame, items: Broadcast) -> np.ndarray:
    """Documents that hold each term of a pass; a task sends its counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, df = items.value.automaton, np.zeros(len(items.value.terms), np.int64)
        for batch in batches:
            for d in texts(batch.column(0)):
                df[occurrences(found, d.tobytes())[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    got = docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(items.value.terms), np.int64)
    out[got["term"].to_numpy()] = got["df"].to_numpy()
    return out


class Best:
    """The ``k`` best rows of each item among those added: highest score, then smallest id (null last), then first added."""

    def __init__(self, k: int, items: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(4)]

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``score`` is documents by items."""
        doc, item = np.nonzero(score >= self.floor)
        new = (item, score[doc, item], null[doc].astype(np.int64), ids[doc])
        item, score, null, ids = (np.concatenate(p) for p in zip(self.rows, new, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        keep = np.arange(len(item)) - first < self.k
        order, item = order[keep], item[keep]
        self.rows = [item, score[order], null[order], ids[order]]
        last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == self.k - 1)
        self.floor[item[last]] = self.rows[1][last]


def _scores(docs: DataFrame, items: Broadcast, weights: Broadcast, n_docs: int, n_all: int, k: int) -> DataFrame:
    """The ``k`` best documents of each item in each task: ``item_id, doc_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, it, w = items.value.automaton, items.value, weights.value
        best = Best(k, len(it.ids))
        height = max(1, BLOCK // len(it.ids))

        def block(held: list[tuple]) -> None:
            score = np.zeros((len(held), len(it.ids)), np.int64)
            size = [len(h[2]) for h in held]
            row = np.repeat(np.arange(len(held)), size)
            term, tf = (np.concatenate([h[c] for h in held]) for c in (2, 3))
            m = np.repeat(np.array([h[4] for h in held], np.int64), size)
            worth = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            for a in range(0, len(term), height * 16):  # the items of a term are listed for so many terms at once
                t = term[a : a + height * 16]
                many = it.start[t + 1] - it.start[t]
                to = it.items[spread(it.start[t], many)]
                np.add.at(score, (np.repeat(row[a : a + height * 16], many), to), np.repeat(worth[a : a + height * 16], many))
            best.add(score, np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], bool))

        held, chars = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, d in zip(ids, texts(batch.column(1)), strict=True):
                data = d.tobytes()
                term, tf = occurrences(found, data)
                if len(term):
                    m = 100 - 50 + (50 * n_terms(data) * n_docs) // n_all
                    held.append((i or 0, i is None, term, tf, m))
                    chars += len(data)
                    if len(held) >= height or chars >= BLOCK_CHARS:
                        block(held)
                        held, chars = [], 0
        if held:
            block(held)
        item, score, null, ids = best.rows
        cols = [it.ids.take(pa.array(item)), pa.array(item), pa.array(ids, mask=null.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "item", "doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "item_id long, item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` documents of each item that score highest: ``item_id, rank, doc_id, score``.

    Terms are maximal runs of ASCII digits and letters (A-Z as a-z) and characters from U+0080 on.
    An automaton of all item terms, each guarded by the gap before and after it, goes to every
    task and reads the documents; nothing is indexed.  One scan counts in how many documents each
    term occurs, a second one scores: a match maps to the items that have the term, and a task
    keeps the ``k`` best documents of an item, so what is shuffled is at most k rows an item and task.
    Items go out in portions of bounded size, two scans each.

    Rows of one item_id and one set of terms are one item; an id with several texts has a list for
    each.  Items and documents without a term (null and empty texts) rank nowhere.  Rows of
    ``docs`` count one by one, repeated ones too; ties go to the smaller doc_id, null last.
    Further columns are ignored; very long texts are read whole; empty tables give no rows.
    """
    spark = docs.sparkSession
    sets = materialize(term_sets(items), "items")
    size = sets.agg(F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + length(t))")).alias("chars"), F.count("*").alias("n")).first()
    n_docs, n_all = statistics(docs)
    passes = max(1, -(-(size["chars"] or 0) // PASS_CHARS), -(-size["n"] // PASS_ITEMS))
    out = None
    for p in range(passes):
        portion = sets.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == p).toArrow()
        if not n_all or not portion.num_rows:
            continue
        held = spark.sparkContext.broadcast(Items(portion["item_id"].to_pylist(), portion["terms"].to_pylist()))
        df = document_frequency(docs, held)
        weights = spark.sparkContext.broadcast(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64))
        best = materialize(_scores(docs, held, weights, n_docs, n_all, k), "best")
        held.destroy()
        weights.destroy()
        order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        got = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    discard(sets)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
