"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Labelled texts that training reads, in expectation; the rest of the labels are not needed.
TRAIN_ROWS = 40_000
AMBIGUOUS = 0.6


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """One row of +1/-1 a language.

    Up to five languages get the exhaustive code (every split of them into two, once); more
    get, of 64 random codes of about 10 log2 n columns, the one with the largest least distance.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = [[1 if (split >> i) & 1 else -1 for i in range(n)] for split in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng, width = np.random.Generator(np.random.PCG64(seed)), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        agree = (code.astype(int) @ code.T.astype(int)) - 10**6 * np.eye(n, dtype=int)
        if code.shape[1] and (code.shape[1] - agree.max()) // 2 > far:
            best, far = code, (code.shape[1] - agree.max()) // 2
    return best


def text_grams(text: str) -> np.ndarray:
    """Hash buckets of the character 1- to 3-grams of a text, lower-cased; runs of non-letters are one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    top = int(c.max(initial=0)) + 1
    if top <= 0x3000:
        blank = ~_letters()[c]
    else:
        blank = np.fromiter((not chr(x).isalpha() for x in c), bool, len(c))
    c = np.where(blank, np.uint32(32), c)
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    one = c
    two = c[1:] * np.uint64(0x1F123BB5) + c[:-1]
    three = two[1:] * np.uint64(0x1F123BB5) + c[:-2]
    mixed = np.concatenate([one * np.uint64(3), two * np.uint64(3) + np.uint64(1), three * np.uint64(3) + np.uint64(2)])
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int32)


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(x).isalpha() for x in range(0x3000)), bool, 0x3000))
    return _table[0]


def pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    """A text in pieces of bounded length, so that a very long one needs no more memory."""
    for at in range(0, len(text), size):
        yield text[at : at + size]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Codebook:
    """``weights[gram, bit]`` are log-odds of a gram in the languages of a bit against the rest."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray
    slope: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Mean log-odds of every bit's classifier over all grams of the whole text."""
        total, n = np.zeros(self.code.shape[1]), 0
        for part in pieces(text):
            grams = text_grams(part)
            counts = np.bincount(grams, minlength=BUCKETS)
            seen = np.flatnonzero(counts)
            total += counts[seen].astype(np.float32) @ self.weights[seen]
            n += len(grams)
        return total / max(n, 1)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous): the codeword with the smallest weighted logistic loss.

        The score is the share of the best codeword in exp(-loss) over all; a text is ambiguous
        if that share is low.
        """
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        m = self.margins(text) * self.slope
        loss = (np.logaddexp(0.0, -self.code * m) * self.bit_weight).sum(axis=1)
        p = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))
        score = float(p[best] / p.sum())
        return self.langs[best], score, score < AMBIGUOUS


def _counts(rows: DataFrame) -> DataFrame:
    """``half, lang, gram, c`` over whole texts; every task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            for half, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = held.setdefault((half, lang), np.zeros(BUCKETS, np.int64))
                for part in pieces(text or ""):
                    total += np.bincount(text_grams(part), minlength=BUCKETS)
        for (half, lang), total in held.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([half] * len(seen), pa.int32()), pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(total[seen])],
                names=["half", "lang", "gram", "c"],
            )

    counted = rows.select("half", "lang", "text").mapInArrow(run, "half int, lang string, gram int, c long")
    return counted.groupBy("half", "lang", "gram").agg(F.sum("c").alias("c"))


def _book(langs: list[str], code: np.ndarray, table: np.ndarray) -> Codebook:
    """Classifiers of all bits from counts ``table[lang, gram]``; languages of a bit's side count alike."""
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    weights = np.zeros((BUCKETS, code.shape[1] if langs else 0), np.float32)
    for b in range(weights.shape[1]):
        yes, no = code[:, b] > 0, code[:, b] < 0
        if yes.any() and no.any():
            weights[:, b] = np.log(share[yes].mean(axis=0)) - np.log(share[no].mean(axis=0))
    return Codebook(langs, code, weights, np.ones(weights.shape[1]), np.ones(weights.shape[1]))


def train(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> Codebook:
    """Fit the bits' classifiers on rows ``doc_id, text, lang`` with non-null lang.

    Texts without a letter teach nothing and are left out.  Of more than ``max_rows`` rows, a
    sample is taken by a hash of doc_id, without a shuffle.  What comes to the driver is the
    model: BUCKETS counts a language and half.  The sample falls into two halves by another
    hash: a second pass asks how well each bit, fitted on one half, does on the other, and
    weighs the bits by that; the final classifiers use both halves.  This is so at every size.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null")
    n = rows.count()
    if n > max_rows:
        share = int(max_rows / n * (1 << 30))
        rows = rows.where((F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)).bitwiseAND(F.lit((1 << 30) - 1))) < share)
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(4)), F.lit(2)).cast("int"))
    got = _counts(rows).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    halves = np.zeros((2, len(langs), BUCKETS))
    if langs:
        index = {x: i for i, x in enumerate(langs)}
        at = np.fromiter((index[x] for x in got["lang"].to_pylist()), int, got.num_rows)
        halves[got["half"].to_numpy(), at, got["gram"].to_numpy()] = got["c"].to_numpy()
    code = codewords(len(langs))
    book = _book(langs, code, halves.sum(axis=0))
    if len(langs) < 2:
        return book
    shared = spark.sparkContext.broadcast([_book(langs, code, halves[1]), _book(langs, code, halves[0])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = code.shape[1]
        good, size, seen = np.zeros(k), np.zeros(k), 0
        for batch in batches:
            for half, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text) and lang in shared.value[half].langs:
                    m = shared.value[half].margins(text) * code[langs.index(lang)]
                    good, size, seen = good + (m > 0), size + np.abs(m), seen + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(good), pa.array(size), pa.array([seen] * k, pa.int64())],
            names=["bit", "good", "size", "seen"],
        )

    found = rows.select("half", "lang", "text").mapInArrow(judge, "bit int, good double, size double, seen long")
    for r in found.groupBy("bit").agg(F.sum("good").alias("g"), F.sum("size").alias("s"), F.sum("seen").alias("n")).collect():
        if r["n"]:
            right = (r["g"] + 1) / (r["n"] + 2)
            book.bit_weight[r["bit"]] = max(0.05, float(np.log(right / (1 - right)))) if right > 0.5 else 0.05
            book.slope[r["bit"]] = 4.0 / max(r["s"] / r["n"], 1e-9)
    book.bit_weight /= book.bit_weight.mean()
    shared.unpersist()
    return book


def predict(docs: DataFrame, book: Codebook) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row; only the text is looked at.

    Null text, or text without a letter, is `und` with score 0 and ambiguous.  Very long texts
    are read in pieces, whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.decode(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(cols[0], pa.string()),
                    pa.array(cols[1], pa.float64()),
                    pa.array(cols[2], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id):
    """True for the fold that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the rows outside the held-out fold and predict all.

    Rows with null doc_id belong to no fold and are not trained on; without any label every
    text is `und`; an empty table gives no rows; further columns are ignored.
    """
    book = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), max_rows)
    out = predict(docs, book)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Documents with a language, columns unchanged; `und` and ambiguous ones go.

    Trained on the labelled rows of ``docs`` outside the held-out fold.  The decision is made
    beside each row, so rows need no key.
    """
    book = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not shared.value.decode(t)[2] for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
