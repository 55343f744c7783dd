"""Repeated-substring removal: a distributed, common-prefix-aware merge sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _powers, fmix, texts
from .tables import materialize

LENGTH = 100
GRAM = 32
#: Suffixes in one sorted run, and members resolved at once.
RUN = 200_000
BATCH = 20_000
#: A window's anchor position takes the low bits of its key; longer texts go in pieces.
_POS = 24
_RAW = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def substring_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of one length, by start."""
    m = len(data) - length + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RAW[data] * p[: len(data)], out=total[1:])
    return fmix((total[length:] - total[:m]) * q[:m])


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbouring keys, from block-wise running minima in both directions."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


@dataclass
class Anchors:
    """Anchor ``at`` serves the windows that start from ``lo`` to ``hi``; ``gram`` hashes its GRAM bytes."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray


def anchors(data: np.ndarray) -> Anchors:
    """The anchors of all windows of LENGTH bytes of a text.

    A window's anchor is the position, inside it, of its least gram hash (the leftmost of
    equals).  It depends on the window's bytes alone, so equal windows have equal anchors at
    equal offsets, and only suffixes that start at anchors need sorting: about one in 35.
    """
    w, out = LENGTH - GRAM + 1, []
    step = (1 << _POS) - LENGTH
    for base in range(0, max(1, len(data) - LENGTH + 1), step):
        part = data[base : base + step + LENGTH - 1]
        h = substring_hashes(part, GRAM)
        if len(h) < w:
            break
        mask = np.uint64((1 << _POS) - 1)
        key = sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), w)
        at = (key & mask).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        out.append((at[first] + base, first + base, last + base, h[at[first]]))
    if not out:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, np.empty(0, np.uint64))
    return Anchors(*(np.concatenate(c) for c in zip(*out, strict=True)))


def digest(data: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(data.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _prefix(data: np.ndarray) -> int:
    """First eight bytes as a number that sorts as the bytes do, shifted to a signed long."""
    return int.from_bytes(data[:8].tobytes().ljust(8, b"\0"), "big") - (1 << 63)


# ---- front-coded runs -------------------------------------------------------------------


@dataclass
class Run:
    """A sorted run of suffixes, front-coded: ``lcp`` bytes are those of the suffix before."""

    lcp: np.ndarray
    rest: list[bytes]
    left: list[bytes]
    lo: np.ndarray
    doc: np.ndarray
    docs: np.ndarray  # rows (rep, hi, lo)


def common_prefixes(suffixes: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it (0 for the first)."""
    n = len(suffixes)
    size = np.fromiter(map(len, suffixes), np.int64, n)
    wide = int(size.max(initial=0))
    mat = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in suffixes), np.uint8).reshape(n, wide)
    out = np.zeros(n, np.int64)
    if n > 1:
        differ = mat[1:] != mat[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def encode_run(suffixes: list[bytes], left: list[bytes], lo: np.ndarray, doc: np.ndarray, docs: np.ndarray) -> bytes:
    """One compressed block of a run whose records are sorted already."""
    lcp = common_prefixes(suffixes)
    rest = [s[k:] for s, k in zip(suffixes, lcp.tolist(), strict=True)]
    used, doc = np.unique(doc, return_inverse=True)
    parts = [
        np.array([len(lcp), len(used)], "<i8").tobytes(),
        lcp.astype(np.uint8).tobytes(),
        np.fromiter(map(len, rest), np.uint8, len(rest)).tobytes(),
        np.fromiter(map(len, left), np.uint8, len(left)).tobytes(),
        lo.astype("<u4").tobytes(),
        doc.astype("<u4").tobytes(),
        docs[used].astype("<i8").tobytes(),
        b"".join(rest),
        b"".join(left),
    ]
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def decode_run(block: bytes) -> Run:
    data = pa.decompress(block[8:], decompressed_size=int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    n, k = np.frombuffer(data, "<i8", 2).tolist()
    at = 16
    lcp, nrest, nleft = (np.frombuffer(data, np.uint8, n, at + i * n).astype(np.int64) for i in range(3))
    at += 3 * n
    lo, doc = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<u4", n, at + 4 * n)
    at += 8 * n
    docs = np.frombuffer(data, "<i8", 3 * k, at).reshape(k, 3)
    at += 24 * k

    def cut(sizes: np.ndarray, start: int) -> tuple[list[bytes], int]:
        ends = (np.cumsum(sizes) + start).tolist()
        return [data[a:b] for a, b in zip([start, *ends[:-1]], ends, strict=True)], ends[-1] if ends else start

    rest, at = cut(nrest, at)
    left, at = cut(nleft, at)
    return Run(lcp, rest, left, lo.astype(np.int64), doc.astype(np.int64), docs)


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, bytes, int, int]]:
    """Merge sorted runs: (common prefix with the suffix before, suffix, run, place in the run).

    A loser tree that keeps, for every waiting suffix, its common prefix with the last winner.
    The longer one wins without looking at bytes; equals are compared from there on, so no byte
    known to be shared is compared again.
    """
    k = len(runs)
    lcps = [r.lcp.tolist() for r in runs]
    cur = [r.rest[0] if r.rest else b"" for r in runs]
    known = [0 if r.rest else -1 for r in runs]  # -1: the run has ended
    at = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = cur[a], cur[b]
        size = min(len(s), len(t))
        p, q = s[x:size], t[x:size]
        if p == q:
            same = size
            first = len(s) <= len(t)
        else:
            gap = (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_length()
            same = size - -(-gap // 8)
            first = p < q
        if first:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    loser = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return won

    top = build(1) if k > 1 else 0
    while known[top] >= 0:
        i = at[top]
        yield known[top], cur[top], top, i
        i += 1
        at[top] = i
        if i < len(lcps[top]):
            shared = lcps[top][i]
            cur[top] = cur[top][:shared] + runs[top].rest[i]
            known[top] = shared
        else:
            known[top] = -1
        node = (top + k) // 2
        while node >= 1:
            won, loser[node] = play(loser[node], top)
            top = won
            node //= 2


# ---- windows ----------------------------------------------------------------------------


def _equal_bytes(data: np.ndarray, at: np.ndarray, leads: np.ndarray, member: np.ndarray, late: np.ndarray) -> bool:
    """Whether windows ``late`` hold the bytes of their leads, whose hashes are equal.

    A window one byte after another that was compared, with leads one byte apart, needs its last byte only.
    """
    a, b = at[late], at[leads[late]]
    on = np.zeros(len(late), bool)
    on[1:] = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1) & (member[late[1:]] == member[late[:-1]])
    if (data[a[on] + LENGTH - 1] != data[b[on] + LENGTH - 1]).any():
        return False
    a, b, reach = a[~on], b[~on], np.arange(LENGTH)
    step = 20_000
    return all((data[a[i : i + step, None] + reach] == data[b[i : i + step, None] + reach]).all() for i in range(0, len(a), step))


def _late_by_bytes(data: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The windows that also start earlier, by their bytes: for the case that different windows share a hash."""
    first: dict[bytes, int] = {}
    keys = [data[x : x + LENGTH].tobytes() for x in at.tolist()]
    for key, p in zip(keys, place.tolist(), strict=True):
        first[key] = min(p, first.get(key, p))
    return np.array([p > first[key] for key, p in zip(keys, place.tolist(), strict=True)], bool)


def later_windows(suffixes, lefts, right, lo, rep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that also start earlier, as (member, from, to) byte ranges.

    Members are suffixes in sorted order; ``right`` is the longest prefix a member shares with a
    neighbour.  A window that starts w bytes into a member's context takes 100 - (len(left) - w)
    bytes of its suffix, so it can only repeat while that many are shared; those windows are
    grouped by hash, compared byte by byte with the first of their group, and all but the first by
    (rep, start) are reported.
    """
    nleft = np.fromiter(map(len, lefts), np.int64, len(lefts))
    nsuf = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    size = nleft + nsuf
    data = np.frombuffer(b"".join(x for pair in zip(lefts, suffixes, strict=True) for x in pair), np.uint8)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = np.maximum(0, np.minimum(size - LENGTH, nleft - LENGTH + right) + 1)
    member = np.repeat(np.arange(len(size)), count)
    w = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
    if not len(member):
        none = np.empty(0, np.int64)
        return none, none, none
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RAW[data] * p[: len(data)], out=total[1:])
    at = base[member] + w
    h = fmix((total[at + LENGTH] - total[at]) * q[at])
    _, rank = np.unique(rep, return_inverse=True)
    place = (rank[member].astype(np.uint64) << np.uint64(32)) | (lo[member] + w).astype(np.uint64)
    order = np.argsort(h)
    hs, ps = h[order], place[order]
    new = np.concatenate([[True], hs[1:] != hs[:-1]])
    group = np.cumsum(new) - 1
    first = np.minimum.reduceat(ps, np.flatnonzero(new))
    lead = order[np.flatnonzero(ps == first[group])]  # a first window of each hash, perhaps more than one
    lead = lead[np.concatenate([[True], h[lead[1:]] != h[lead[:-1]]])]
    late = np.zeros(len(h), bool)
    late[order] = ps > first[group]
    leads = np.empty(len(h), np.int64)
    leads[order] = lead[group]
    if not _equal_bytes(data, at, leads, member, np.flatnonzero(late)):
        late = _late_by_bytes(data, at, place)
    f = np.flatnonzero(late)
    if not len(f):
        none = np.empty(0, np.int64)
        return none, none, none
    cut = np.concatenate([[True], (np.diff(f) != 1) | (member[f[1:]] != member[f[:-1]])])
    a = f[cut]
    b = f[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(f) - 1]])]
    return member[a], lo[member[a]] + w[a], lo[member[b]] + w[b] + LENGTH


def resolve(merged: Iterator[tuple[int, bytes, int, int]], runs: list[Run]):
    """Walk merged suffixes group by group (shared anchor grams) and yield (hi, lo, from, to) arrays."""
    held: list[tuple[int, bytes, int, int]] = []

    def flush():
        lcp = np.array([h[0] for h in held] + [0])
        lcp[0] = 0
        right = np.maximum(lcp[:-1], lcp[1:])
        keep = np.flatnonzero(right >= GRAM)
        if not len(keep):
            return None
        mine = [held[i] for i in keep]
        lefts = [runs[r].left[i] for _, _, r, i in mine]
        lo = np.array([runs[r].lo[i] for _, _, r, i in mine])
        doc = np.array([runs[r].docs[runs[r].doc[i]] for _, _, r, i in mine])
        member, a, b = later_windows([m[1] for m in mine], lefts, right[keep], lo, doc[:, 0])
        return doc[member, 1], doc[member, 2], a, b

    for item in merged:
        if item[0] < GRAM:
            if len(held) >= BATCH:
                if (out := flush()) is not None:
                    yield out
                held = []
            elif held and held[-1][0] < GRAM:
                held.pop()  # it shares its gram with neither neighbour
        held.append(item)
    if held and (out := flush()) is not None:
        yield out


# ---- Spark jobs -------------------------------------------------------------------------


def _scan(docs: DataFrame) -> DataFrame:
    """``doc_id, hi, lo, n, sha`` of every row; and, in ``prefix``, a thin sample of eight-byte prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            his, los, n, sha, prefix = [], [], [], [], []
            for data in texts(batch.column(1)):
                hi, lo = digest(data)
                his.append(hi)
                los.append(lo)
                n.append(len(data))
                sha.append(hashlib.sha256(data.tobytes()).hexdigest())
                for at in range(hi % 8192, len(data) - GRAM, 8192):
                    prefix.append(_prefix(data[at:]))
            none, more = [None] * len(prefix), [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + none, pa.int64()),
                    pa.array(his + none, pa.int64()),
                    pa.array(los + none, pa.int64()),
                    pa.array(n + none, pa.int64()),
                    pa.array(sha + none, pa.string()),
                    pa.array(more + prefix, pa.int64()),
                ],
                names=["doc_id", "hi", "lo", "n", "sha", "prefix"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, hi long, lo long, n long, sha string, prefix long")


def _grams(docs: DataFrame) -> DataFrame:
    """Anchor grams of distinct texts: ``part, gram, hi, twice, settled``.

    ``twice``: known to repeat.  What a portion of texts knows to repeat (in two of its texts, or twice
    in one) needs no further look: all its rows but one are ``settled`` and dealt by text, and one
    goes on by gram to tell other portions.  So a gram of very many texts sends a few rows by gram.
    """

    def portion(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, hi, twice = (np.concatenate(c) for c in zip(*held, strict=True))
        _, first, place, count = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
        often = np.bitwise_or.reduceat(twice[np.argsort(place, kind="stable")], np.cumsum(count) - count) | (count > 1)
        known = often[place]
        settled = known.copy()
        settled[first] = False
        cols = [pa.array(np.where(settled, hi, gram)), pa.array(gram), pa.array(hi), pa.array(known), pa.array(settled)]
        return pa.RecordBatch.from_arrays(cols, names=["part", "gram", "hi", "twice", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for data in texts(batch.column(0)):
                if len(data) < LENGTH or (d := digest(data)) in seen:
                    continue
                if len(seen) >= RUN:
                    seen.clear()
                seen.add(d)
                gram, n = np.unique(anchors(data).gram, return_counts=True)
                held.append((gram.view(np.int64), np.full(len(gram), d[0], np.int64), n > 1))
                size += len(gram)
                if size > RUN:
                    yield portion(held)
                    held, size = [], 0
        if held:
            yield portion(held)

    return docs.select("text").mapInArrow(run, "part long, gram long, hi long, twice boolean, settled boolean")


def _repeated(grams: DataFrame) -> DataFrame:
    """``hi, gram`` of grams that occur in two texts or twice in one; the rest cannot repeat 100 bytes.

    Rows come sorted, so a stream with one row of memory decides; a frequent gram needs no buffer.
    Settled rows pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is held back until the next one is known
        gram = hi = np.empty(0, np.int64)
        twice = np.empty(0, bool)
        before: tuple[int, int] | None = None

        def emit(last: bool):
            nonlocal gram, hi, twice, before
            n = len(gram)
            same_next = np.zeros(n, bool)
            same_next[:-1] = (gram[1:] == gram[:-1]) & (hi[1:] != hi[:-1])
            same_prev = np.zeros(n, bool)
            same_prev[1:] = same_next[:-1]
            # equal (gram, hi) rows stand side by side: what one knows holds for all of them
            key = np.concatenate([[True], (gram[1:] != gram[:-1]) | (hi[1:] != hi[:-1])]) if n else np.empty(0, bool)
            if n and before is not None and before[0] == gram[0] and before[1] != hi[0]:
                same_prev[0] = True
            yes = same_next | same_prev | twice
            if n:
                start = np.flatnonzero(key)
                any_ = np.logical_or.reduceat(yes, start)
                whole = start if last else start[:-1]
                ok = any_[: len(whole)]
                out = gram[whole][ok], hi[whole][ok]
                rest = n if last else start[-1]
                if rest > 0:
                    before = (int(gram[rest - 1]), int(hi[rest - 1]))
                gram, hi, twice = gram[rest:], hi[rest:], twice[rest:]
                # many equal rows in a row need no more room than one
                if len(gram) > 1:
                    gram, hi, twice = gram[:1], hi[:1], np.array([twice.any()])
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[1]), pa.array(out[0])], names=["hi", "gram"])

        for batch in batches:
            g, h, t, done = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[done]), pa.array(g[done])], names=["hi", "gram"])
                g, h, t = g[~done], h[~done], t[~done]
            gram, hi, twice = np.concatenate([gram, g]), np.concatenate([hi, h]), np.concatenate([twice, t.astype(bool)])
            yield from emit(False)
        yield from emit(True)

    sorted_ = grams.repartition("part").sortWithinPartitions("gram", "hi")
    return sorted_.select("gram", "hi", "twice", "settled").mapInArrow(run, "hi long, gram long")


def _runs(texts_: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Sorted front-coded runs cut at the range bounds, ``part, block``; and byte ranges settled inside a run.

    Members with equal contexts in one run need not travel: all but the first are settled here.
    """
    cuts = texts_.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int, int]] = []
        recs: list[tuple[bytes, bytes, int, int, int, int]] = []

        def out(parts, blocks, ranges):
            n, m = len(parts), len(ranges)
            cols = list(zip(*ranges, strict=True)) if m else [()] * 4
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*parts, *(c % max(1, len(cuts.value)) for c in range(m))], pa.int32()),
                    pa.array([*blocks, *[None] * m], pa.binary()),
                    *[pa.array([None] * n + list(c), pa.int64()) for c in cols],
                ],
                names=["part", "block", "hi", "lo", "from", "to"],
            )

        def flush():
            nonlocal docs, recs
            recs.sort()  # by suffix, left context, rep, lo: equal contexts stand together, the first of them first
            kept, ranges = [], []
            for r in recs:
                k = kept[-1] if kept else None
                if k is not None and k[0] == r[0] and k[1] == r[1] and (k[2], k[3]) < (r[2], r[3]):
                    d = docs[r[5]]
                    ranges.append((d[1], d[2], r[3], r[4] + LENGTH))
                    continue
                kept.append(r)
            table = np.array(docs, np.int64).reshape(-1, 3)
            heads = np.array([_prefix(np.frombuffer(r[0][:8], np.uint8)) for r in kept], np.int64)
            part = np.searchsorted(cuts.value, heads, side="right")
            edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(kept)]]) if kept else np.array([0])
            parts, blocks = [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                some = kept[a:b]
                parts.append(int(part[a]))
                blocks.append(
                    encode_run([r[0] for r in some], [r[1] for r in some], np.array([r[3] for r in some]), np.array([r[5] for r in some]), table)
                )
            docs, recs = [], []
            return out(parts, blocks, ranges)

        for batch in batches:
            rep, hi, lo, wanted = (batch.column(c) for c in range(4))
            for i, data in enumerate(texts(batch.column(4))):
                a = anchors(data)
                mine = np.isin(a.gram, wanted[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                raw, own = data.tobytes(), (rep[i].as_py(), hi[i].as_py(), lo[i].as_py())
                places = a.at[mine], a.lo[mine], a.hi[mine]
                for some in range(0, len(places[0]), RUN):  # a text of many anchors fills several runs
                    d = len(docs)
                    docs.append(own)
                    for at, x, y in zip(*(c[some : some + RUN].tolist() for c in places), strict=True):
                        recs.append((raw[at : y + LENGTH], raw[x:at], own[0], x, y, d))
                    if len(recs) >= RUN:
                        yield flush()
        if recs:
            yield flush()

    rows = texts_.select("rep", "hi", "lo", "grams", "text")
    return rows.mapInArrow(run, "part int, block binary, hi long, lo long, from long, to long")


def _merge(runs: DataFrame) -> DataFrame:
    """Merge the runs of each range: ``hi, lo, from, to`` byte ranges to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []

        def settle():
            decoded = [decode_run(b) for b in blocks]
            for hi, lo, a, b in resolve(merge_runs(decoded), decoded):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (hi, lo, a, b)], names=["hi", "lo", "from", "to"])

        for batch in batches:
            block = batch.column("block")
            ready = batch.filter(block.is_null()).select(["hi", "lo", "from", "to"])
            if ready.num_rows:
                yield ready
            parts = batch.column("part").to_pylist()
            for i in range(batch.num_rows):
                if block[i].is_valid:
                    if parts[i] != now:
                        if blocks:
                            yield from settle()
                        now, blocks = parts[i], []
                    blocks.append(block[i].as_py())
        if blocks:
            yield from settle()

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "hi long, lo long, from long, to long")


def _apply(rows: DataFrame) -> DataFrame:
    """Cut the ranges out of each text: ``hi, lo, cut, spans, kept_sha``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los, ranges = (batch.column(c) for c in range(3))
            cut, spans, sha = [], [], []
            for i, data in enumerate(texts(batch.column(3))):
                cell = ranges[i].values
                a = cell.field("from").to_numpy(zero_copy_only=False)
                b = cell.field("to").to_numpy(zero_copy_only=False)
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
                gone = np.cumsum(depth)[:-1] > 0
                cut.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
                sha.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [his, los, pa.array(cut, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                names=["hi", "lo", "cut", "spans", "kept_sha"],
            )

    return rows.select("hi", "lo", "ranges", "text").mapInArrow(run, "hi long, lo long, cut long, spans long, kept_sha string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a 100-byte string that also starts earlier.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.  Earlier means a smaller
    doc_id, or the same doc_id and an earlier start; judged on the input.  Steps:

    1. Equal texts are one class, held by their smallest doc_id; a later copy of 100 bytes or
       more goes whole.
    2. Every 100-byte window names an anchor inside it by content; anchors whose 32 bytes occur
       once are dropped (a filter that loses nothing).
    3. Suffixes at the other anchors, with what their windows reach to the left, are sorted into
       runs, front-coded, cut by range and merged by loser trees on common prefixes; windows of
       suffixes that share enough are compared, all but the first are removed.

    Null text is empty (nothing removed, digest of nothing).  Texts under 100 bytes lose nothing.
    Rows that repeat doc_id and text start at the same place, so neither is earlier; a null
    doc_id is after all others.  Further columns are ignored; an empty table gives no rows.
    """
    last = (1 << 63) - 1
    scan = materialize(_scan(docs), "suffix-scan")
    rows = scan.where("n is not null").drop("prefix").withColumn("ord", F.coalesce("doc_id", F.lit(last)))
    classes = rows.where(F.col("n") >= LENGTH).groupBy("hi", "lo").agg(F.min("ord").alias("rep"))
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = scan.where("prefix is not null")
    quantiles = sample.agg(F.percentile_approx("prefix", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0]
    bounds = np.unique(np.array(quantiles or [0], np.int64))

    wanted = _repeated(_grams(docs)).groupBy("hi").agg(F.collect_list("gram").alias("grams"))  # at most a text's anchors
    keyed = classes.join(wanted, "hi").select("hi", "lo", "rep", "grams")
    source = _with_digest(docs, last)
    held = source.join(keyed, (source["t_hi"] == keyed["hi"]) & (source["t_lo"] == keyed["lo"]) & (source["ord"] == keyed["rep"]))
    held = materialize(held.select("rep", "hi", "lo", "grams", "text"), "suffix-texts")

    found = _merge(_runs(held, bounds))
    found = found.groupBy("hi", "lo").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    done = _apply(held.select("hi", "lo", "text").join(found, ["hi", "lo"])).dropDuplicates(["hi", "lo"])
    named = classes.join(done, ["hi", "lo"], "left")
    out = rows.join(named, ["hi", "lo"], "left")
    whole = F.coalesce(F.col("ord") > F.col("rep"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def _with_digest(docs: DataFrame, last: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds = [digest(data) for data in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in ds], pa.int64()), pa.array([d[1] for d in ds], pa.int64()), batch.column(1)],
                names=["ord", "t_hi", "t_lo", "text"],
            )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("ord"), "text").where(F.octet_length("text") >= LENGTH)
    return rows.mapInArrow(run, "ord long, t_hi long, t_lo long, text string")
