"""Secret scans through a trigram inverted index (native expressions only)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache, reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match stays if its ``group`` has ``min_length`` characters.

    The pattern is the same to Java and to Python.  Its trigram query is derived from it by
    :func:`trigram_query`.
    """

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0


# The three base rules of the scan, then published formats of credentials.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs of 32 or more are the long ones among all maximal runs, so asking for them directly drops the same matches
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULES = (
    *BASE,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# ---- trigram queries from patterns ---------------------------------------------------------

#: A query is an AND of factors; a factor is an OR of sets of trigrams, each set an AND.  No factor: always true.
Factor = frozenset[frozenset[str]]
Query = tuple[Factor, ...]
#: Strings that a part of a pattern is followed through; more are cut back, which weakens the query and keeps it true.
MOST = 32


@dataclass(frozen=True)
class Part:
    """What is known of the strings that a part of a pattern matches.

    All of them if ``exact``; else some string of ``prefix`` begins and one of ``suffix`` ends each
    of them, and ``query`` holds for each.
    """

    exact: frozenset[str] | None
    prefix: frozenset[str] = frozenset([""])
    suffix: frozenset[str] = frozenset([""])
    query: Query = ()


EMPTY, ANY = Part(frozenset([""])), Part(None)


def trigrams(word: str) -> frozenset[str]:
    return frozenset(word[i : i + 3] for i in range(len(word) - 2))


def _least(sets: Iterable[frozenset[str]]) -> Factor:
    """An OR without alternatives that another one follows from."""
    kept: list[frozenset[str]] = []
    for s in sorted(set(sets), key=len):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept)


def _of_strings(strings: Iterable[str]) -> Query:
    """True of every text that holds one of the strings."""
    factor = _least(map(trigrams, strings))
    return () if frozenset() in factor else (factor,)


def _either(a: Query, b: Query) -> Query:
    out = dict.fromkeys(_least(x | y) for x in a for y in b)
    return tuple(f for f in out if len(f) <= MOST)


def _both(*queries: Query) -> Query:
    return tuple(dict.fromkeys(f for q in queries for f in q))


def _cut(strings: Iterable[str], ends: bool) -> frozenset[str]:
    """At most MOST beginnings (or ends) of the strings."""
    got = frozenset(strings)
    size = max(map(len, got), default=0)
    while len(got) > MOST:
        size -= 1
        got = frozenset(s[len(s) - size if len(s) > size else 0 :] if ends else s[:size] for s in got)
    return got


def _open(p: Part) -> Part:
    """The same without ``exact``."""
    return p if p.exact is None else Part(None, _cut(p.exact, False), _cut(p.exact, True), _of_strings(p.exact))


def _then(a: Part, b: Part) -> Part:
    """``a`` followed by ``b``."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return Part(frozenset(x + y for x in a.exact for y in b.exact))
    x, y = _open(a), _open(b)
    prefix = _cut((e + p for e in a.exact for p in y.prefix), False) if a.exact is not None else x.prefix
    suffix = _cut((s + e for s in x.suffix for e in b.exact), True) if b.exact is not None else y.suffix
    across = _of_strings(s + p for s in x.suffix for p in y.prefix)
    return Part(None, prefix, suffix, _both(x.query, y.query, across))


def _or(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST:
        return Part(a.exact | b.exact)
    x, y = _open(a), _open(b)
    return Part(None, _cut(x.prefix | y.prefix, False), _cut(x.suffix | y.suffix, True), _either(x.query, y.query))


def _class(items: list, fold: bool) -> Part:
    """A character class: its characters if they are few."""
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MOST:
            chars.update(map(chr, range(arg[0], arg[1] + 1)))
        else:  # negated, a category or a long range
            return ANY
    chars = {c.lower() for c in chars} if fold else chars
    return Part(frozenset(chars)) if len(chars) <= MOST // 2 else ANY


def _describe(tree, fold: bool) -> Part:
    out = EMPTY
    for op, arg in tree:
        if op is sre.LITERAL:
            part = Part(frozenset([chr(arg).lower() if fold else chr(arg)]))
        elif op is sre.IN:
            part = _class(arg, fold)
        elif op is sre.BRANCH:
            part = reduce(_or, [_describe(t, fold) for t in arg[1]])
        elif op is sre.SUBPATTERN:
            part = _describe(arg[3], fold)
        elif op is sre.ATOMIC_GROUP:
            part = _describe(arg, fold)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            one = _describe(inner, fold)
            part = reduce(_then, [one] * min(least, 4), EMPTY)
            if most > min(least, 4):
                part = _or(one, EMPTY) if (least, most) == (0, 1) else _then(part, ANY)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = EMPTY  # takes no characters
        else:  # any character, a back reference, ...
            part = ANY
        out = _then(out, part)
    return out


def _ignores_case(tree) -> bool:
    found = bool(getattr(tree, "state", None) and tree.state.flags & re.IGNORECASE)
    for op, arg in tree:
        if op is sre.SUBPATTERN:
            found |= bool(arg[1] & re.IGNORECASE) or _ignores_case(arg[3])
        elif op is sre.BRANCH:
            found |= any(map(_ignores_case, arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            found |= _ignores_case(arg[2])
        elif op is sre.ATOMIC_GROUP:
            found |= _ignores_case(arg)
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            found |= _ignores_case(arg[1])
    return found


@cache
def trigram_query(pattern: str) -> tuple[bool, Query]:
    """(whether it is asked of the lower-cased text, query): true of every text that the pattern matches.

    The parse tree is read from the leaves up: literals and small classes are sets of strings,
    concatenation multiplies them, alternation unites them, and what grows too large is cut
    to its ends after its trigrams were noted.  A pattern without mandatory trigrams gets the
    empty query and scans fully.
    """
    tree = _parser.parse(pattern)
    fold = _ignores_case(tree)
    return fold, _open(_describe(tree, fold)).query


# ---- index, candidates, verification -------------------------------------------------------


def terms_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries name, with their case mode: "i:pas" or "s:AKI"."""
    asked = set()
    for r in rules:
        fold, query = trigram_query(r.pattern)
        asked |= {("i:" if fold else "s:") + t for f in query for s in f for t in s}
    return sorted(asked)


def keyed(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows with a key of their own: ``key, doc_id, text, terms`` (places, in ``terms_of``, of the trigrams that the text holds)."""

    def held(text: Column, mode: str) -> Column:
        own = [F.struct(F.lit(t[2:]).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms_of(rules)) if t.startswith(mode)]
        none = F.array().cast("array<int>")
        return _bind(text, lambda x: F.transform(F.filter(F.array(*own), lambda a: x.contains(a["t"])), lambda a: a["i"])) if own else none

    terms = F.concat(held(F.col("text"), "s:"), held(F.lower("text"), "i:"))
    return docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("terms", terms)


def postings(rows: DataFrame) -> DataFrame:
    """Inverted index ``(term, key)`` over the trigrams that the rules' queries name."""
    return rows.select("key", F.explode("terms").alias("term"))


#: Bits of one word of a document's set of terms, and of its set of rules.
WORD = 60


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows that satisfy a rule's trigram query: ``key, rules0, rules1, ...``, a bit a rule.

    Posting lists are intersected and united as bit sets: one aggregation with map-side
    combine turns the lists into the set of terms of each row.
    """
    place = {t: divmod(i, WORD) for i, t in enumerate(terms_of(rules))}
    words = range(-(-len(place) // WORD))
    bit = F.expr(f"shiftleft(1L, term % {WORD})")
    got = index.groupBy("key").agg(*[F.bit_or(F.when(F.floor(F.col("term") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"have{w}") for w in words] or [F.lit(0).alias("have0")])

    def holds(terms: list[str]) -> Column:
        ok = F.lit(True)
        for w in words:
            mask = sum(1 << bit for at, bit in (place[t] for t in terms) if at == w)
            if mask:
                ok = ok & (F.col(f"have{w}").bitwiseAND(F.lit(mask).cast("long")) == mask)
        return ok

    none = F.lit(0).cast("long")
    bits = [none] * _rule_words(rules)
    for i, r in enumerate(rules):
        fold, query = trigram_query(r.pattern)
        if query:
            mode = "i:" if fold else "s:"
            factors = [reduce(Column.__or__, [holds([mode + t for t in sorted(s)]) for s in sorted(f, key=sorted)]) for f in query]
            at, bit = divmod(i, WORD)
            bits[at] = bits[at] + F.when(reduce(Column.__and__, factors), F.lit(1 << bit).cast("long")).otherwise(none)
    got = got.select("key", *[b.alias(f"rules{w}") for w, b in enumerate(bits)])
    return got.where(reduce(Column.__or__, [F.col(f"rules{w}") != 0 for w in range(len(bits))]))


def _rule_words(rules: tuple[Rule, ...]) -> int:
    return max(1, -(-len(rules) // WORD))


SPAN = "array<struct<start:int,ord:int,end:int>>"
#: Matches put into one array at a time; arrays of arrays are put together in turn, so that many matches cost no square.
CHUNK = 512


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, rule: Rule, order: int) -> Column:
    """All kept matches of one rule: array of (start, order, end) in code points, end exclusive.

    Positions come from the lengths of the pieces between matches (split) and of the matches
    (extract_all), which cut the same text at the same places.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def size(gap: Column, hit: Column) -> Column:
        value = F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit
        return F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), (F.length(value) >= rule.min_length).alias("keep"))

    none = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["keep"], F.lit(False)), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        got = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return _bind(got, lambda g: F.struct(g["at"].alias("at"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    def whole(sizes: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int"))
        parts = F.transform(cuts, lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.flatten(F.aggregate(parts, zero, chunk, lambda acc: acc["out"]))

    return F.when(text.rlike(rule.pattern), _bind(F.zip_with(gaps, hits, size), whole)).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document with its verified spans: ``doc_id, spans`` (array sorted by start, rule).

    Only texts that pass a rule's trigram query are matched against it; rules without a query
    match all; there may be any number of rules.  Rows are written with a key of their own, which the
    index names, so doc_id may be null or repeated.  Null and empty texts have no spans; further columns are
    ignored; an empty table gives no rows.  The work on a text grows with its length, however
    many matches it holds.
    """
    rows = materialize(keyed(docs, rules), "keyed")
    cand = candidates(postings(rows), rules)
    # both sides grow with the input: a sort-merge join at every size, never a broadcast
    rows = rows.drop("terms").join(cand.hint("merge"), "key", "left")
    parts = []
    for i, r in enumerate(rules):
        found = spans(F.col("text"), r, i)
        if trigram_query(r.pattern)[1]:
            at, bit = divmod(i, WORD)
            asked = F.coalesce(F.col(f"rules{at}"), F.lit(0)).bitwiseAND(F.lit(1 << bit)) != 0
            found = F.when(asked, found).otherwise(F.array().cast(SPAN))
        parts.append(found)
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def describe(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Counts of the first ``base`` kinds, digest of their spans, all spans as text, and the number of others."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def text(which: Column) -> Column:
        one = lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(which, one), ",")

    def count(low: int, high: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"].between(low, high))).cast("long")

    counts = [count(i, i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    first = text(F.filter("spans", lambda s: s["ord"] < base))
    return found.select(
        "doc_id", *counts, F.sha2(first, 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count(base, len(rules)).alias("n_more")
    )
