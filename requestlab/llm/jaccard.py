"""Exact n-gram Jaccard join with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import fingerprint, shingle_set, texts
from .tables import connected_components, discard, materialize

#: Shingles whose order comes last in prefixes: a bounded list of the most frequent ones.  It
#: steers the cost only; prefixes are complete under any common order.
FREQUENT = 200_000
#: Shares of the hash range looked at by the two pruning rounds; they steer the cost only.
REGIONS = (0.3, 0.6)
#: Shingles held by one tree.
UNIT = 4_000_000
LEAF = 16
FAN = 8
SEEN = 200_000


def _ceil(n, percent: int):
    return -(-n * percent // 100)


class Node:
    """A range of documents: OR of their bitmaps, sizes from ``least`` to ``most``."""

    __slots__ = ("bits", "children", "hi", "least", "lo", "most", "slack")

    def __init__(self, lo, hi, bits, least, most, slack, children):
        self.lo, self.hi, self.bits, self.least, self.most, self.slack = lo, hi, bits, least, most, slack
        self.children = children


class SignatureTree:
    """Documents in the order of (size level, smallest hash), so that likely partners are neighbours.

    Bitmaps hash shingles to bits.  For a in A and b in B, every shared shingle sets a bit in
    both bitmaps, and a document's shingles exceed its bits by its ``slack``; so the overlap is
    at most popcount(A & B) + min(slack), and never above either size.
    """

    def __init__(self, sets: list[np.ndarray], width: int):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        for i, s in enumerate(sets):
            pos = (s >> np.uint64(20)) & np.uint64(width - 1)
            np.bitwise_or.at(self.bits[i], (pos >> np.uint64(6)).astype(np.int64), np.uint64(1) << (pos & np.uint64(63)))
        self.pop = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.slack = self.sizes - self.pop
        level = [self._node(i, min(i + LEAF, len(sets)), []) for i in range(0, len(sets), LEAF)]
        while len(level) > 1:
            level = [self._node(c[0].lo, c[-1].hi, c) for c in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0] if level else None

    def _node(self, lo, hi, children):
        if children:
            bits = np.bitwise_or.reduce([c.bits for c in children])
            return Node(lo, hi, bits, min(c.least for c in children), max(c.most for c in children), max(c.slack for c in children), children)
        bits = np.bitwise_or.reduce(self.bits[lo:hi], axis=0)
        return Node(lo, hi, bits, self.sizes[lo:hi].min(), self.sizes[lo:hi].max(), self.slack[lo:hi].max(), [])


class Join:
    """Dual traversal of two trees (or of one with itself) that meets every link between them once.

    A pair of nodes is dropped when sizes are too far apart or when the largest possible overlap is
    below what the smallest sizes need; documents that are united already are compared all the same,
    since every link counts.  ``degree`` adds up the weights of a document's partners.
    """

    def __init__(self, left: SignatureTree, right: SignatureTree, percent: int, weights: np.ndarray):
        self.a, self.b, self.percent = left, right, percent
        self.same = left is right
        self.shift = 0 if self.same else len(left.sets)
        self.parent = np.arange(len(left.sets) + (0 if self.same else len(right.sets)))
        self.weights = weights
        self.degree = np.zeros(len(self.parent), np.int64)
        self._number()
        self.now = None

    def _number(self) -> None:
        """Shingles as dense numbers, all documents of a tree in one array with bounds."""
        sets = self.a.sets if self.same else self.a.sets + self.b.sets
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        known, ids = np.unique(grams, return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.slot = np.full(len(known), -1, np.int32)

    def _rows(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingle numbers of documents ``lo`` to ``hi`` and, for each, its document's place among them."""
        at = self.at[lo : hi + 1]
        return self.ids[at[0] : at[-1]], np.repeat(np.arange(hi - lo), np.diff(at))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def run(self) -> None:
        if self.a.root is None or self.b.root is None:
            return
        stack = [(self.a.root, self.b.root)]
        while stack:
            x, y = stack.pop()
            most = max(x.least, y.least)
            if 100 * x.most < self.percent * y.least or 100 * y.most < self.percent * x.least:
                continue
            if not (self.same and x is y):
                best = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack)
                if 100 * best < self.percent * most:
                    continue
            if not x.children and not y.children:
                self._leaves(x, y)
            elif self.same and x is y:
                kids = x.children
                stack += [(p, q) for i, p in enumerate(kids) for q in kids[i + 1 :]]
                stack += [(p, p) for p in kids]
            elif x.children and (not y.children or x.hi - x.lo >= y.hi - y.lo):
                stack += [(p, y) for p in x.children]
            else:
                stack += [(x, q) for q in y.children]

    def _shared(self, x: Node, y: Node) -> np.ndarray:
        """Exact overlaps of the documents of two leaves: a product of 0/1 matrices over the shingles of ``x``."""
        if self.now is not x:
            if self.now is not None:
                self.slot[self.own] = -1
            ids, row = self._rows(x.lo, x.hi)
            self.own = np.unique(ids)
            self.slot[self.own] = np.arange(len(self.own))
            self.left = np.zeros((x.hi - x.lo, len(self.own)), np.float32)
            self.left[row, self.slot[ids]] = 1
            self.now = x
        ids, row = self._rows(y.lo + self.shift, y.hi + self.shift)
        to = self.slot[ids]
        hit = to >= 0
        right = np.zeros((y.hi - y.lo, len(self.own)), np.float32)
        right[row[hit], to[hit]] = 1
        return np.rint(self.left @ right.T).astype(np.int64)  # exact: overlaps are below 2^24

    def _leaves(self, x: Node, y: Node) -> None:
        a, b, per = self.a, self.b, self.percent
        na, nb = a.sizes[x.lo : x.hi, None], b.sizes[None, y.lo : y.hi]
        both = np.bitwise_count(a.bits[x.lo : x.hi, None, :] & b.bits[None, y.lo : y.hi, :]).sum(axis=2).astype(np.int64)
        both += np.minimum(a.slack[x.lo : x.hi, None], b.slack[None, y.lo : y.hi])
        both = np.minimum(both, np.minimum(na, nb))
        # |a n b| * 100 >= per * |a u b|  <=>  |a n b| * (100 + per) >= per * (|a| + |b|)
        ok = both * (100 + per) >= per * (na + nb)
        itself = self.same and x is y
        if itself:
            np.fill_diagonal(ok, False)
        if not ok.any():
            return
        ok &= self._shared(x, y) * (100 + per) >= per * (na + nb)
        if not ok.any():
            return
        left, right = slice(x.lo, x.hi), slice(y.lo + self.shift, y.hi + self.shift)
        self.degree[left] += ok.astype(np.int64) @ self.weights[right]
        if not itself:
            self.degree[right] += ok.T.astype(np.int64) @ self.weights[left]
        r = np.array([self.find(i) for i in range(left.start, left.stop)])
        s = np.array([self.find(i) for i in range(right.start, right.stop)])
        for i, j in zip(*np.nonzero(ok & (r[:, None] != s[None, :])), strict=True):
            p, q = self.find(int(r[i])), self.find(int(s[j]))
            if p != q:
                self.parent[max(p, q)] = min(p, q)


def _width(sizes: list[int]) -> int:
    typical = sorted(sizes)[len(sizes) // 2] if sizes else 1
    return min(65536, max(512, 1 << (4 * typical - 1).bit_length()))


def _scan(docs: DataFrame) -> DataFrame:
    """Per row ``key, text``: the key as it is, and ``n, hi, lo`` (set size and fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, his, los = [], [], []
            for data in texts(batch.column(1)):
                s = shingle_set(data)
                hi, lo = fingerprint(s) if len(s) else (None, None)
                n.append(len(s))
                his.append(hi)
                los.append(lo)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, his, los))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "hi", "lo"])

    return docs.select("key", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, n long, hi long, lo long")


def _often(docs: DataFrame, frequent: int) -> np.ndarray:
    """The ``frequent`` most frequent shingles, sorted; counted in portions that add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            grams, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["gram", "c"])

        for batch in batches:
            for data in texts(batch.column(0)):
                held.append(shingle_set(data))
                size += len(held[-1])
                if size >= 2_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    got = docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).where("c >= 8")
    top = got.orderBy(F.desc("c"), "gram").limit(frequent).select("gram").toArrow()["gram"].to_numpy()
    return np.sort(np.ascontiguousarray(top).view(np.uint64)) if len(top) else np.empty(0, np.uint64)


def _crowded(docs: DataFrame, sizes: DataFrame, share: float, percent: int) -> DataFrame:
    """Sets that may link, ``node, n``: those with too few shingles of their own.

    Looks at the shingles whose hash lies in the lowest ``share`` of all.  Order shingles so that
    those of them which one set alone holds come first: a set with at least
    n - ceil(percent n) + 1 such shingles has a prefix that no other set shares, so it has no link.
    """
    top = np.uint64(int(share * 2**64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, nodes, held = [], [], 0
            for data in texts(batch.column(0)):
                s = shingle_set(data)
                if not len(s) or (f := fingerprint(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(f)
                low = s[: int(np.searchsorted(s, top, side="right"))]
                keys.append(low.view(np.int64))
                nodes.append(np.full(len(low), f[0], np.int64))
                held += len(low)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
                    keys, nodes, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    keys = docs.select("text").mapInArrow(run, "key long, node long")
    keys = keys.groupBy("key").agg(F.min("node").alias("node"), F.max("node").alias("high"))
    own = keys.where("node = high").groupBy("node").agg(F.count("*").alias("own"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return sizes.join(own.hint("merge"), "node", "left").where(F.coalesce("own", F.lit(0)) < prefix).select("node", "n")


def _prefixes(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """Prefix entries ``key, node``: the first n - ceil(percent n) + 1 shingles, frequent ones last.

    Two sets that link share a shingle of both prefixes, whatever the common order is.
    """
    last = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        often = last.value
        for batch in batches:
            keys, nodes, held = [], [], 0
            for data in texts(batch.column(0)):
                s = shingle_set(data)
                if not len(s) or (f := fingerprint(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(f)
                p = len(s) - _ceil(len(s), percent) + 1
                if len(often):
                    at = np.searchsorted(often, s)
                    at[at == len(often)] = 0
                    late = often[at] == s
                    s = np.concatenate([s[~late], s[late]])
                keys.append(s[:p].view(np.int64))
                nodes.append(np.full(p, f[0], np.int64))
                held += p
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
                    keys, nodes, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return docs.select("text").mapInArrow(run, "key long, node long")


def _with_sets(docs: DataFrame) -> DataFrame:
    """``hi, lo, text`` of the distinct sets that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            his, los, keep = [], [], []
            for data in texts(batch.column(0)):
                s = shingle_set(data)
                f = fingerprint(s) if len(s) else None
                new = f is not None and f not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(f)
                    his.append(f[0])
                    los.append(f[1])
                keep.append(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(his, pa.int64()), pa.array(los, pa.int64()), batch.column(0).filter(pa.array(keep, pa.bool_()))],
                names=["hi", "lo", "text"],
            )

    return docs.select("text").mapInArrow(run, "hi long, lo long, text string")


def _units(comp: DataFrame, unit: int) -> DataFrame:
    """Deal the nodes of every candidate component to units: ``node, unit, side, split``.

    A component of at most ``unit`` shingles is one unit.  A larger one is cut into blocks by
    size level (levels grow by 5/4, so links join equal or adjacent levels only) and, inside a
    level, by a hash into as many blocks as its shingles need; every pair of blocks of equal or
    adjacent levels is a unit, with the first block on side 0 and the other on side 1.
    """
    total = comp.groupBy("component").agg(F.sum("n").alias("total"))
    whole = ["node", F.col("component").cast("string").alias("unit"), F.lit(0).alias("side"), F.lit(False).alias("split")]
    big = materialize(total.where(F.col("total") > unit).select("component"), "big")
    if big.isEmpty():
        return comp.select(*whole)
    one = comp.join(big, "component", "left_anti").select(*whole)
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")
    cut = comp.join(big, "component").withColumn("level", level)
    blocks = cut.groupBy("component", "level").agg(F.ceil(F.sum("n") * 2 / unit).cast("int").alias("r"))
    cut = cut.join(blocks, ["component", "level"]).withColumn("h", F.pmod(F.xxhash64("node"), F.col("r")).cast("int"))
    up = blocks.select("component", (F.col("level") - 1).alias("level"), F.col("r").alias("r_up"))
    down = blocks.select("component", (F.col("level") + 1).alias("level"), F.col("r").alias("r_down"))
    cut = cut.join(up, ["component", "level"], "left").join(down, ["component", "level"], "left")

    def name(lv, i, j, kind):
        return F.concat_ws(":", F.col("component"), lv, F.lit(kind), i, j)

    same = cut.select("node", "component", "level", "h", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("o"))
    same = same.select(
        "node",
        name(F.col("level"), F.least("h", "o"), F.greatest("h", "o"), "s").alias("unit"),
        (F.col("h") > F.col("o")).cast("int").alias("side"),
        F.lit(True).alias("split"),
    )
    as_low = cut.where("r_up is not null").select("node", "component", "level", "h", F.explode(F.sequence(F.lit(0), F.col("r_up") - 1)).alias("o"))
    as_low = as_low.select("node", name(F.col("level"), F.col("h"), F.col("o"), "x").alias("unit"), F.lit(0).alias("side"), F.lit(True).alias("split"))
    as_high = cut.where("r_down is not null").select("node", "component", "level", "h", F.explode(F.sequence(F.lit(0), F.col("r_down") - 1)).alias("o"))
    as_high = as_high.select("node", name(F.col("level") - 1, F.col("o"), F.col("h"), "x").alias("unit"), F.lit(1).alias("side"), F.lit(True).alias("split"))
    return one.unionByName(same).unionByName(as_low).unionByName(as_high)


def _join_units(rows: DataFrame, percent: int) -> DataFrame:
    """Run the trees of each unit: ``hi, lo, root_hi, root_lo, split, links`` (united with root in its unit).

    ``links`` counts the documents that a set links to in the unit, each set as often as it has
    ``copies``.  Two sets meet in one unit only, so counts of units add up.
    """

    def solve(split: bool, sides: list[dict], copies: dict) -> pa.RecordBatch:
        trees, names = [], []
        width = _width([len(s) for side in sides for s in side.values()])
        for side in sides:
            order = sorted(side, key=lambda f: (len(side[f]).bit_length(), int(side[f][0]), len(side[f])))
            trees.append(SignatureTree([side[f] for f in order], width))
            names += order
        other = trees[1] if split and sides[1] else trees[0]
        join = Join(trees[0], other, percent, np.array([copies[f] for f in names], np.int64))
        join.run()
        root = [join.find(i) for i in range(len(join.parent))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in names], pa.int64()),
                pa.array([f[1] for f in names], pa.int64()),
                pa.array([names[r][0] for r in root], pa.int64()),
                pa.array([names[r][1] for r in root], pa.int64()),
                pa.array([split] * len(names), pa.bool_()),
                pa.array(join.degree),
            ],
            names=["hi", "lo", "root_hi", "root_lo", "split", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, split, sides, copies = None, False, [{}, {}], {}
        for batch in batches:
            unit, side, cut, hi, lo, many = (batch.column(c).to_pylist() for c in range(6))
            for i, data in enumerate(texts(batch.column(6))):
                if unit[i] != now:
                    if now is not None:
                        yield solve(split, sides, copies)
                    now, split, sides, copies = unit[i], cut[i], [{}, {}], {}
                f = (hi[i], lo[i])
                if f not in sides[side[i]]:
                    sides[side[i]][f] = shingle_set(data)
                    copies[f] = many[i]
        if now is not None:
            yield solve(split, sides, copies)

    rows = rows.select("unit", "side", "split", "hi", "lo", "copies", "text")
    return rows.mapInArrow(run, "hi long, lo long, root_hi long, root_lo long, split boolean, links long")


def jaccard_classes(docs: DataFrame, percent: int = 80, unit: int = UNIT, frequent: int = FREQUENT) -> DataFrame:
    """Classes of documents under links of Jaccard >= percent/100: ``doc_id, n_shingles, component_id, n_links``.

    1. Texts with equal shingle sets are one class; only one text of a class goes on.
    2. Classes with enough shingles of their own cannot link and leave (two rounds, the second
       among what the first kept).
    3. Prefix entries deal candidates: classes that share a prefix shingle are tied to the
       smallest class under that shingle (a star, not all pairs), and stars join to candidate
       components, which hold every possible link.
    4. Each candidate component, cut into bounded units where large, is joined by signature
       trees; every link is verified on the exact sets and counted at both ends.
    5. Verified links give components, named by their smallest doc_id.

    ``n_links`` is the number of other rows that the row's text links to: a set of c copies gives
    its rows c - 1 and the copies of every set it links to, so no pair of rows is written.
    Null and empty texts have no shingles and stay alone, each row under its own doc_id.
    Repeated rows are linked; null doc_ids take part and are never a class's smallest id unless
    alone.  Further columns are ignored; an empty table gives no rows.  Shingles are 64-bit
    hashes, sets are named by 128 bits.
    """
    mine = materialize(_scan(docs.selectExpr("cast(doc_id as long) key", "text")).withColumnRenamed("key", "doc_id"), "scan")
    named = _set_classes(docs, mine, percent, unit, frequent)
    least = named.groupBy("root_hi", "root_lo").agg(F.min("rep").alias("component_id"))
    named = named.join(least, ["root_hi", "root_lo"]).select("hi", "lo", "component_id", "n_links")
    out = mine.join(named.hint("merge"), ["hi", "lo"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _set_classes(docs: DataFrame, mine: DataFrame, percent: int, unit: int = UNIT, frequent: int = FREQUENT) -> DataFrame:
    """Every distinct set with the root of its component: ``hi, lo, rep, root_hi, root_lo, n_links``."""
    classes = materialize(
        mine.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")), "classes"
    )
    sizes = classes.groupBy(F.col("hi").alias("node")).agg(F.max("n").alias("n"))
    # what grows with the input is joined by sort and merge at every size
    first = _crowded(docs, sizes, REGIONS[0], percent).hint("merge")
    wide = materialize(_with_sets(docs).join(first, F.col("hi") == F.col("node")).drop("node"), "crowded")
    second = materialize(_crowded(wide, wide.select(F.col("hi").alias("node"), "n").distinct(), REGIONS[1], percent), "second")
    held = materialize(wide.join(second.select("node").hint("merge"), F.col("hi") == F.col("node")).drop("node", "n"), "held")
    discard(wide)

    entries = materialize(_prefixes(held, _often(held, frequent), percent), "prefix", "lz4")
    keys = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    stars = entries.join(keys.hint("merge"), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    comp = materialize(connected_components(stars).join(second.hint("merge"), "node"), "comp")
    discard(entries, second)
    dealt = _units(comp, unit)
    dealt = dealt.join(classes.select("hi", "lo", "copies").hint("merge"), F.col("hi") == F.col("node")).drop("node")
    work = held.join(dealt.hint("merge"), ["hi", "lo"])
    work = work.repartition("unit").sortWithinPartitions("unit", "side", "hi", "lo")
    united = materialize(_join_units(work, percent), "united")
    discard(held, comp)

    if united.where("split").isEmpty():
        roots = united.select("hi", "lo", "root_hi", "root_lo").distinct()
    else:
        links = united.where("split and hi <> root_hi").select(F.col("hi").alias("a"), F.col("root_hi").alias("b"))
        whole = connected_components(links).select(F.col("node").alias("hi"), F.col("component").alias("root_hi"))
        cut = united.where("split").select("hi", "lo").distinct().join(whole, "hi", "left")
        cut = cut.select("hi", "lo", F.coalesce("root_hi", "hi").alias("root_hi"), F.lit(0).cast("long").alias("root_lo"))
        roots = united.where("not split").select("hi", "lo", "root_hi", "root_lo").distinct().unionByName(cut)
    links = united.groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    named = classes.join(roots, ["hi", "lo"], "left").join(links, ["hi", "lo"], "left")
    return named.select(
        "hi", "lo", "rep", F.coalesce("root_hi", "hi").alias("root_hi"), F.coalesce("root_lo", "lo").alias("root_lo"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Exactly one row of each class; columns unchanged.

    The row with the smallest doc_id stays, null last; among rows of that doc_id (repeated ids) the
    one with the smallest hash of all its columns, and of rows equal in all columns any one.  Rows
    count one by one, whatever ids they share: a row goes only if another row of its own class stays.
    Null and empty texts have no shingles, are in no class and all stay.
    """
    cols = docs.columns
    # rows get a key that holds once it is written
    keyed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), F.monotonically_increasing_id().alias("key")), "keyed")
    plain = keyed.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    row = F.struct("key", F.col("doc.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.to_json("doc")).alias("digest"))
    mine = _scan(keyed.select(row.alias("key"), F.col("doc.text").alias("text")))
    mine = materialize(mine.select("key.*", "n", "hi", "lo"), "scan")
    named = _set_classes(plain, mine, percent).select("hi", "lo", "root_hi", "root_lo")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "key")).alias("first")
    best = mine.where("n > 0").groupBy("hi", "lo").agg(first).select("hi", "lo", "first.*")
    best = best.join(named, ["hi", "lo"]).groupBy("root_hi", "root_lo").agg(first).select("first.key")
    stay = materialize(best.unionByName(mine.where("n = 0").select("key")), "stay")
    rows = keyed.join(stay.hint("merge"), "key", "left_semi")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in cols])
