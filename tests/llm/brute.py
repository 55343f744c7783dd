"""Plain-Python versions of the operators' contracts."""

import hashlib
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n=5):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}; docs have distinct ids."""
    first, out = {}, {}
    data = sorted((i, (t or "").encode()) for i, t in docs)
    for i, d in data:
        for p in range(len(d) - length + 1):
            first.setdefault(d[p : p + length], (i, p))
    for i, d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if first[d[p : p + length]] != (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


WORDS = "(?i:password|passwd|secret|token|api_?key)"
RULES = [
    ("assign", re.compile("(" + WORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    ("slack", re.compile(r"xox[baprs]-[A-Za-z0-9-]{10,}"), 0, 0),
    ("google", re.compile(r"AIza[0-9A-Za-z_-]{35}"), 0, 0),
    ("stripe", re.compile(r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"), 0, 0),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 0),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
]


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256, spans, n_more)"""
    found = []
    for o, (kind, pattern, group, least) in enumerate(RULES):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), o, m.end(), kind))
    found.sort()
    digits = lambda f: ",".join(f"{k}:{a}:{b}" for a, _, b, k in f)
    counts = tuple(sum(f[1] == o for f in found) for o in range(3))
    base = digits([f for f in found if f[1] < 3])
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), digits(found), sum(f[1] >= 3 for f in found))


def contained(docs, items, percent=80):
    out = set()
    for item, t in items:
        words = WORD.findall(lower(t or ""))
        if not words:
            continue
        s = shingles(t)
        for i, d in docs:
            w, n = WORD.findall(lower(d or "")), min(5, len(words))
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            shared = len(s & have)
            if 100 * shared >= percent * len(s):
                out.add((i, item, shared, len(s)))
    return out


def targets(sizes, weights, cap=3):
    """Targets by resharing the excess over and over."""
    total, open_ = sum(sizes), set(range(len(sizes)))
    t = [0.0] * len(sizes)
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > cap * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                t[i] = left * weights[i] / w
            return t
        for i in over:
            t[i] = float(cap * sizes[i])
        left -= sum(t[i] for i in over)
        open_ -= over
    return t


def crc_ids(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def classes_by_bits(docs, distance=3):
    """{row number: (fingerprint, component_id)} of rows (doc_id, text), by comparing all pairs."""
    import xxhash

    prints = []
    for _, t in docs:
        words = WORD.findall(lower(t or ""))
        n = min(3, len(words))
        h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(len(words) - n + 1)] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    known = sorted(set(prints))
    parent = {f: f for f in known}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, f in enumerate(known):
        for g in known[a + 1 :]:
            if (f ^ g).bit_count() <= distance:
                parent[find(f)] = find(g)
    least = {}
    for (i, _), f in zip(docs, prints, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(docs, prints, strict=True)]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k=50):
    """Rows (item_id, rank, doc_id, score); docs may repeat, items have distinct ids."""
    import collections
    import math

    tf = [(i, collections.Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, n_all = len(tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        terms, rows = set(TERM.findall(lower(text or ""))), []
        for i, c in tf:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return out


def tree(nodes):
    """(root, list of the paths of every node: (side, sibling) or None on each level)."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, k in enumerate(at):
            paths[n].append((("L" if k % 2 else "R"), nodes[k ^ 1]) if k ^ 1 < len(nodes) else None)
        nodes, at = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)], [k // 2 for k in at]
    return nodes[0], paths


def merkle(rows):
    """Rows of the manifest, from (doc_id, source, lang, n_chars, text)."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(part, r)))
    langs, made = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())), {}
    for x in langs:
        own = sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[x] = (own, *tree([leaf(r) for r in own]))
    if not langs:
        return []
    root, ups = tree([made[x][1] for x in langs])
    out = []
    for x, up in zip(langs, ups, strict=True):
        own, sub, paths = made[x]
        for r, path in zip(own, paths, strict=True):
            changed = r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, whole = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r), path + up
            for s in whole:
                node = h(node) if s is None else h(s[1] + node if s[0] == "L" else node + s[1])
            out.append((r[0], leaf(r), sub, root, h("".join(s[1] for s in whole if s)), node, node == root))
    return out
