"""Merkle manifest of a table: leaf coordinates by bitmap ranks, levels by slot arrays."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, materialize

#: Ids of one container: 2^CHUNK_BITS neighbours.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
#: Levels that one slot array reduces: it has 2^STEP slots.
STEP = 8
#: Ids that a task gathers before it sends containers.
GATHER = 1_000_000


# ---- containers: compressed sets of the low bits of ids -------------------------------------


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct low bits as 16-bit numbers, or as a bitmap where that is shorter."""
    if 16 * len(low) < CHUNK:
        return low.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[low] = 1
    return b"\0" + np.packbits(bits, bitorder="little").tobytes()  # an odd length marks a bitmap


def unpack(data: bytes) -> np.ndarray:
    """The low bits of a container, ascending."""
    if len(data) % 2 == 0:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


class Ranks:
    """Rank queries on one container; ids that occur more often count as often as they do.

    A bitmap has a directory of popcounts, one for the words before each 64-bit word, so a rank is
    one look-up and one popcount; a short container is searched.
    """

    def __init__(self, ids: bytes, rep_low: bytes, rep_more: bytes):
        self.words = None
        if len(ids) % 2:
            self.words = np.frombuffer(ids[1:], "<u8")
            ones = np.bitwise_count(self.words).astype(np.int64)
            self.before = np.concatenate([[0], np.cumsum(ones)])
        else:
            self.low = np.frombuffer(ids, "<u2").astype(np.int64)
        self.rep = np.frombuffer(rep_low, "<u2").astype(np.int64)
        self.more = np.concatenate([[0], np.cumsum(np.frombuffer(rep_more, "<i8"))])

    def below(self, low: np.ndarray) -> np.ndarray:
        """Rows whose id is smaller, for each of the low bits asked."""
        if self.words is None:
            rank = np.searchsorted(self.low, low)
        else:
            at = low >> 6
            mask = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
            rank = self.before[at] + np.bitwise_count(self.words[at] & mask)
        return rank + self.more[np.searchsorted(self.rep, low)]


_CONTAINER = "tree string, chunk long, ids binary, rep_low binary, rep_more binary, n long"


def _containers(rows: DataFrame) -> DataFrame:
    """The containers of what each task reads, GATHER ids at a time: _CONTAINER."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            trees = t.column("tree").combine_chunks().dictionary_encode()
            tree, key = trees.indices.to_numpy(), t.column("chunk").to_numpy()
            low = t.column("low").to_numpy()
            cell, many = np.unique(np.stack([tree.astype(np.int64), key, low]), axis=1, return_counts=True)
            cuts = np.flatnonzero((np.diff(cell[:2], axis=1) != 0).any(axis=0)) + 1
            out: list[list] = [[] for _ in range(6)]
            names = trees.dictionary.to_pylist()
            for a, b in zip([0, *cuts], [*cuts, cell.shape[1]], strict=True):
                for c, v in zip(out, _row(names[cell[0, a]], int(cell[1, a]), cell[2, a:b], many[a:b]), strict=True):
                    c.append(v)
            return _batch(out)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GATHER:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return rows.select("tree", "chunk", "low").mapInArrow(run, _CONTAINER)


def _row(tree: str, chunk: int, low: np.ndarray, many: np.ndarray) -> tuple:
    often = many > 1
    return tree, chunk, pack(low), low[often].astype("<u2").tobytes(), (many[often] - 1).astype("<i8").tobytes(), int(many.sum())


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["tree", "chunk", "ids", "rep_low", "rep_more", "n"])


def _merged(parts: DataFrame) -> DataFrame:
    """One container a tree and chunk: the tasks' containers united, rows of one id added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for tree, chunk, some in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                many = np.zeros(CHUNK, np.int64)
                for p in some:
                    many[unpack(p["ids"])] += 1
                    many[np.frombuffer(p["rep_low"], "<u2")] += np.frombuffer(p["rep_more"], "<i8")
                low = np.flatnonzero(many)
                for c, v in zip(out, _row(tree, chunk, low, many[low]), strict=True):
                    c.append(v)
            yield _batch(out)

    grouped = parts.groupBy("tree", "chunk").agg(F.collect_list(F.struct("ids", "rep_low", "rep_more")).alias("some"))
    return grouped.mapInArrow(run, _CONTAINER)


def bitmap_index(rows: DataFrame) -> DataFrame:
    """Containers of each tree with their place in it: _CONTAINER, ``base`` (rows before), ``total`` (rows of the tree).

    ``rows`` has ``tree, chunk, low``.  Containers are dealt by ranges of (tree, chunk); sums of the
    ranges and then sums inside a range give ``base``, so no window holds a whole tree.
    """
    merged = _merged(_containers(rows)).repartitionByRange("tree", "chunk")
    index = materialize(merged.withColumn("part", F.spark_partition_id()), "bitmaps")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = index.groupBy("tree", "part").agg(F.sum("n").alias("m"))
    sums = sums.select("tree", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"), F.sum("m").over(tree).alias("total"))
    inside = Window.partitionBy("tree", "part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums.hint("merge"), ["tree", "part"])
    return placed.select("tree", "chunk", "ids", "rep_low", "rep_more", (F.col("first") + F.col("inside")).alias("base"), "total", "n")


_RANKED = "tree string, doc_id long, leaf string, changed string, pos long, n long"


def _rank(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with their coordinate: ``tree, doc_id, leaf, changed, pos, n`` (n: leaves of the tree).

    A container and the rows of its chunk meet in one task, the container first; ranks are asked
    of it, rows are not ordered.
    """
    none = {c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("low", "int"), ("leaf", "string"), ("changed", "string"))}
    a = index.select("tree", "chunk", F.lit(0).alias("kind"), "ids", "rep_low", "rep_more", "base", "total", *[v.alias(c) for c, v in none.items()])
    none = {c: F.lit(None).cast(t) for c, t in (("ids", "binary"), ("rep_low", "binary"), ("rep_more", "binary"), ("base", "long"), ("total", "long"))}
    b = rows.select("tree", "chunk", F.lit(1).alias("kind"), *[v.alias(c) for c, v in none.items()], "doc_id", "low", "leaf", "changed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, base, total = None, 0, 0
        for batch in batches:
            kind, low = batch.column("kind").to_numpy(), batch.column("low")
            low = low.fill_null(0).to_numpy().astype(np.int64)
            pos, size = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            heads = np.flatnonzero(kind == 0)
            for k, (at, end) in enumerate(zip([-1, *heads], [*heads, len(kind)], strict=True)):
                if k:
                    ids, rep_low, rep_more, base, total = (batch.column(c)[int(at)].as_py() for c in ("ids", "rep_low", "rep_more", "base", "total"))
                    ranks = Ranks(ids, rep_low, rep_more)
                if end > at + 1:
                    pos[at + 1 : end], size[at + 1 : end] = base + ranks.below(low[at + 1 : end]), total
            keep = pa.array(kind == 1)
            cols = [batch.column(c).filter(keep) for c in ("tree", "doc_id", "leaf", "changed")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pos[kind == 1]), pa.array(size[kind == 1])], names=["tree", "doc_id", "leaf", "changed", "pos", "n"])

    both = a.unionByName(b).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "kind")
    return both.mapInArrow(run, _RANKED)


def _coordinates(leaves: DataFrame) -> DataFrame:
    """_RANKED for all rows, those with repeated or null ids included.

    A repeated id is ranked once.  Its rows follow one another by leaf, equal ones counted, not
    listed; a third of all rows may share it: they are split by the first digits of the leaf.
    """
    index = materialize(bitmap_index(leaves), "ranks")
    repeated = index.where("length(rep_low) > 0").select("tree", "chunk").distinct()
    if repeated.isEmpty():
        return _rank(leaves, index)
    key = ["tree", "chunk", "low"]
    often = leaves.join(repeated.hint("merge"), ["tree", "chunk"], "left_semi").groupBy(*key).agg(F.count("*").alias("c"), F.first("doc_id").alias("doc_id")).where("c > 1").drop("c")
    often = materialize(often, "repeated")
    single = leaves.join(often.hint("merge"), key, "left_anti")
    first = _rank(often.select(*key, "doc_id", F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("changed")), index)
    first = first.select("tree", F.col("doc_id").alias("id"), F.col("pos").alias("first"), "n")
    rows = leaves.join(often.hint("merge"), key, "left_semi")
    rows = rows.groupBy("tree", F.col("doc_id").alias("id"), "leaf", "changed").agg(F.count("*").alias("c"))
    rows = materialize(rows.withColumn("digits", F.substring("leaf", 1, 3)), "repeats")
    upto = Window.unboundedPreceding, -1
    cells = rows.groupBy("tree", "id", "digits").agg(F.sum("c").alias("m"))
    cells = cells.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("tree", "id").orderBy("digits").rowsBetween(*upto)), F.lit(0))).drop("m")
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("tree", "id", "digits").orderBy("leaf").rowsBetween(*upto)), F.lit(0))
    rows = _by(_by(rows.withColumn("inside", inside), cells, "tree", "id", "digits"), first, "tree", "id")
    rows = rows.withColumnRenamed("id", "doc_id").withColumn("start", F.col("first") + F.col("before") + F.col("inside"))
    # equal rows take the places one after the other, listed by blocks so that tasks share them
    rows = rows.withColumn("part", F.explode(F.expr(f"sequence(0L, (c - 1) div {CHUNK})"))).repartition("start", "part")
    rows = rows.withColumn("pos", F.explode(F.expr(f"sequence(start + part * {CHUNK}, start + least(c, (part + 1) * {CHUNK}) - 1)")))
    return _rank(single, index).unionByName(rows.select("tree", "doc_id", "leaf", "changed", "pos", "n"))


def _by(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """The rows of ``a`` with those of ``b`` that have their key, where null is a key as any other."""
    named = b.withColumnsRenamed({k: f"{k}_" for k in key})
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return a.join(named.hint("merge"), same).drop(*[f"{k}_" for k in key])


# ---- levels ---------------------------------------------------------------------------------


def levels(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and the ``height`` levels above them; a node is the hash of up to two below."""
    out = [nodes]
    for _ in range(height):
        low = out[-1]
        out.append([sha256(b"".join(low[i : i + 2])).hexdigest().encode() for i in range(0, len(low), 2)])
    return out


def siblings(rows: list[list[bytes]], i: int) -> list[bytes]:
    """From the bottom: side and hash of the sibling on each level, nothing where a node is alone."""
    out = []
    for row in rows[:-1]:
        other = i ^ 1
        out.append(((b"L" if other < i else b"R") + row[other]) if other < len(row) else b"")
        i >>= 1
    return out


def fold(node: bytes, path: list[bytes]) -> bytes:
    """The root that a node and its siblings give."""
    for s in path:
        node = sha256(s[1:] + node if s[:1] == b"L" else node + s[1:]).hexdigest().encode()
    return node


def _height(n: int, step: int) -> int:
    """Levels that a slot array of a tree of ``n`` nodes reduces."""
    return min(step, (n - 1).bit_length())


def _slots(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray, list[bytes]]]:
    """Of every array of a batch: its row, its items, and their nodes by slot."""
    items = batch.column("items")
    flat, at = items.flatten(), items.offsets.to_numpy() - items.offsets[0].as_py()
    slot, node = flat.field("slot").to_numpy(), flat.field("node").to_pylist()
    for r in range(batch.num_rows):
        a, b = int(at[r]), int(at[r + 1])
        placed = [b""] * (b - a)
        for k, x in zip(slot[a:b].tolist(), node[a:b], strict=True):
            placed[k] = x.encode()
        yield r, flat.slice(a, b - a), placed


def _slot_arrays(nodes: DataFrame, step: int, *more: str) -> DataFrame:
    """``tree, block, n, items``: every 2^step nodes in an array, keyed by slot; items have ``slot, node`` and ``more``."""
    item = F.struct(F.expr(f"cast(pos & {(1 << step) - 1} as int)").alias("slot"), "node", *more)
    return nodes.groupBy("tree", F.expr(f"pos >> {step}").alias("block")).agg(F.first("n").alias("n"), F.collect_list(item).alias("items"))


def _tops(blocks: DataFrame, step: int) -> DataFrame:
    """The next nodes: ``tree, pos, node, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n").to_pylist()
            top = [levels(placed, _height(size[r], step))[-1][0].decode() for r, _, placed in _slots(batch)]
            n = [-(-x // (1 << step)) for x in size]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(top, pa.string()), pa.array(n, pa.int64())], names=["tree", "pos", "node", "n"])

    return blocks.mapInArrow(run, "tree string, pos long, node string, n long")


def _grow(nodes: DataFrame, step: int, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """All slot arrays, from the bottom, and the tops of the trees."""
    arrays = []
    while True:
        arrays.append(materialize(_slot_arrays(nodes, step, *(more if not arrays else ())), "slots"))
        nodes = materialize(_tops(arrays[-1], step), "tops")
        if nodes.where("n > 1").isEmpty():
            return arrays, nodes


_UP = "tree string, pos long, subroot string, root string, up array<binary>"


def _down(arrays: DataFrame, up: DataFrame, step: int) -> DataFrame:
    """Paths to the root of the nodes in slot arrays, from those of the arrays' tops: _UP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, block, size, subroot, root, ups = (batch.column(c).to_pylist() for c in ("tree", "block", "n", "subroot", "root", "up"))
            for r, _, placed in _slots(batch):
                rows, m = levels(placed, _height(size[r], step)), len(placed)
                first = block[r] << step
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree[r]] * m, pa.string()), pa.array(np.arange(first, first + m)), pa.array([subroot[r]] * m, pa.string()),
                        pa.array([root[r]] * m, pa.string()), pa.array([siblings(rows, i) + ups[r] for i in range(m)], pa.list_(pa.binary())),
                    ],
                    names=["tree", "pos", "subroot", "root", "up"],
                )

    return _meet(arrays, up).mapInArrow(run, _UP)


def _meet(arrays: DataFrame, up: DataFrame) -> DataFrame:
    return arrays.join(up.withColumnRenamed("pos", "block").hint("merge"), ["tree", "block"])


def _proofs(arrays: DataFrame, up: DataFrame, step: int) -> DataFrame:
    """Per leaf its proof, and the root that the leaf as it is found now gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, subroot, root, ups = (batch.column(c).to_pylist() for c in ("n", "subroot", "root", "up"))
            for r, items, placed in _slots(batch):
                rows = levels(placed, _height(size[r], step))
                proof, folded = [], []
                for i, leaf, changed in zip(*(items.field(c).to_pylist() for c in ("slot", "node", "changed")), strict=True):
                    path = siblings(rows, i) + ups[r]
                    proof.append(sha256(b"".join(s[1:] for s in path)).hexdigest())
                    folded.append(fold((changed or leaf).encode(), path).decode())
                m = len(proof)
                yield pa.RecordBatch.from_arrays(
                    [
                        items.field("doc_id"), items.field("node"), pa.array([subroot[r]] * m, pa.string()), pa.array([root[r]] * m, pa.string()),
                        pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array([f == root[r] for f in folded], pa.bool_()),
                    ],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return _meet(arrays, up).mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


# ---- the operator ---------------------------------------------------------------------------


def leaf_hash(*values: Column) -> Column:
    """Hex sha256 of the values, each as its UTF-8 length, a colon and itself, null as ``-``."""

    def part(v: Column) -> Column:
        s = v.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(part, values)), 256)


def tampered(doc_id: Column, n_chars: Column) -> Column:
    """``n_chars`` after tampering, null where nothing changes: one more where 7 divides the id's crc32."""
    return F.when(F.crc32(doc_id.cast("string")) % 7 == 0, n_chars.cast("decimal(20,0)") + 1)


def manifest(docs: DataFrame, step: int = STEP) -> DataFrame:
    """Each row's leaf in a Merkle tree over the table, with its proof and what the proof says of the row now.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; one tree a lang, and one
    over the langs' roots.  Ids of a lang are gathered as compressed bitmaps, merged by chunks
    of neighbours; a rank in them is a leaf's place, so leaves are never sorted by id.
    Nodes meet in slot arrays of 2^step, each of which reduces ``step`` levels; paths go down
    the same arrays.  Texts are read once; what is shuffled are hashes.

    Rows without an id come first in their lang and are never tampered with; rows that share an id
    follow one another by their leaf.  Null texts and values count as such, empty texts as empty;
    a null lang is a tree of its own; further columns are ignored; an empty table gives no rows.
    The langs' roots are numbered in one task: their number is taken to fit it.
    """
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")]
    now = tampered(fields[0], fields[3])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), fields[2].cast("string")), F.lit("")).alias("tree"),
        fields[0].alias("doc_id"),
        F.coalesce(F.shiftright(fields[0], CHUNK_BITS), F.lit(-(1 << (63 - CHUNK_BITS)) - 1)).alias("chunk"),
        F.coalesce(fields[0].bitwiseAND(F.lit(CHUNK - 1)), F.lit(0)).cast("int").alias("low"),
        leaf_hash(*fields).alias("leaf"),
        F.when(now.isNotNull(), leaf_hash(*fields[:3], now, fields[4])).alias("changed"),
    )
    leaves = materialize(leaves, "leaves")
    arrays, tops = _grow(_coordinates(leaves).withColumnRenamed("leaf", "node"), step, "doc_id", "changed")

    every = Window.partitionBy()
    numbered = tops.select(
        F.lit("").alias("tree"), F.col("tree").alias("lang"), "node",
        (F.row_number().over(Window.orderBy("tree")) - 1).cast("long").alias("pos"), F.count("*").over(every).alias("n"),
    )
    numbered = materialize(numbered, "langs")
    above, top = _grow(numbered, step)
    up = top.selectExpr("tree", "pos", "cast(null as string) subroot", "node root", "cast(array() as array<binary>) up")
    for a in reversed(above):
        up = _down(a, up, step)
    up = numbered.join(up.drop("subroot").hint("merge"), ["tree", "pos"]).selectExpr("lang tree", "0L pos", "node subroot", "root", "up")
    for a in reversed(arrays[1:]):
        up = _down(a, up, step)
    out = materialize(_proofs(arrays[0], up, step), "proofs")
    discard(leaves, tops, numbered, top, *arrays, *above)
    return out
