"""Mixing sources to target weights by entropy balancing (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import discard, materialize

#: Maximal runs of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, cap: int = CAP) -> DataFrame:
    """Targets of sources (``source, source_size``): weights 1..cycle repeating in code point order, null last.

    Resharing the excess of sources above ``cap`` times their size until none is above ends
    at one level t with target = min(cap * size, weight * t) and a sum equal to all sizes; t
    is read off the sources sorted by cap * size / weight.  One row per source is handled.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    src = sizes.withColumn("idx", F.row_number().over(order) - 1).withColumn("w", (F.col("idx") % cycle + 1).cast("double"))
    top = F.lit(float(cap)) * F.col("source_size")
    w = W.orderBy(top / F.col("w"), "idx")
    upto, all_ = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    src = src.withColumn("total", F.sum(F.col("source_size").cast("double")).over(all_))
    src = src.withColumn("capped", F.sum(top).over(upto) - top)
    src = src.withColumn("left_w", F.sum("w").over(all_) - F.sum("w").over(upto) + F.col("w"))
    src = src.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_w"))
    # The first source, in this order, that stays below its cap fixes the level; all fit if none does.
    src = src.withColumn("level", F.when(F.col("w") * F.col("level") <= top, F.col("level")))
    src = src.withColumn("level", F.min(F.struct(F.col("level").isNull(), top / F.col("w"), F.col("level"))).over(all_)["level"])
    target = F.when(F.col("level").isNull(), top).otherwise(F.least(top, F.col("w") * F.col("level")))
    return src.select("source", "idx", "source_size", target.alias("target"))


def tilt(hist: DataFrame, src: DataFrame, cap: int = CAP, rounds: int = 60) -> DataFrame:
    """Solve the dual of entropy balancing for every source: ``(idx, lam, scale)``.

    Rates minimise sum r ln r - r under sum size * r = target and r <= cap, so
    r = min(cap, exp(lam * size / scale)).  Each round is one aggregation of the size
    histogram (a distributed sum of value and slope), then a Newton step on the logarithm of
    the sum, which is nearly straight, kept inside a shrinking bracket, so it cannot run away
    where the cap makes the slope small.  It ends within a millionth of the target.
    """
    state = src.select(
        "idx",
        F.col("target"),
        (F.col("source_size") / F.col("n")).alias("scale"),
        F.lit(0.0).alias("lam"),
        F.lit(-1e6).alias("lo"),
        F.lit(1e6).alias("hi"),
        F.lit(False).alias("ok"),
        # nothing to solve for an empty source, or one that takes every document ``cap`` times
        ((F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))).alias("open"),
    )
    state = materialize(state.coalesce(1), "tilt")  # a row a source
    x = F.col("size") / F.col("scale")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * x)))
    for _ in range(rounds):
        live = state.where("open and not ok")
        sums = (
            hist.where("size > 0")
            .join(live.select("idx", "lam", "scale"), "idx")
            .groupBy("idx")
            .agg(
                F.sum(F.col("c") * F.col("size") * rate).alias("got"),
                F.sum(F.when(rate < cap, F.col("c") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        j = state.join(sums, "idx", "left")
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.col("got") * F.log(F.col("got") / F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        # bisect the bracket on a logarithmic grid while it is still wide
        mid = F.when((lo > -1e6) & (hi < 1e6), (lo + hi) / 2).when(hi >= 1e6, F.greatest(2 * F.col("lam"), F.lit(0.5))).otherwise(
            F.least(2 * F.col("lam"), F.lit(-0.5))
        )
        done = F.abs(gap) <= 1e-6 * F.col("target") + 0.5
        last = state
        state = materialize(
            j.select(
                "idx", "target", "scale",
                F.when(F.col("got").isNull() | done, F.col("lam")).otherwise(F.when(inside, newton).otherwise(mid)).alias("lam"),
                F.when(F.col("got").isNull(), F.col("lo")).otherwise(lo).alias("lo"),
                F.when(F.col("got").isNull(), F.col("hi")).otherwise(hi).alias("hi"),
                F.coalesce(done, F.col("ok")).alias("ok"),
                "open",
            ).coalesce(1),
            "tilt",
        )
        discard(last)
        if state.where("open and not ok").isEmpty():
            break
    return state.select("idx", "lam", "scale", "open")


def mix(docs: DataFrame, cap: int = CAP, fixups: int = 6, bucket_rows: int = 200_000) -> DataFrame:
    """Copies of every document so that each source's words come near its target.

    Returns ``doc_id, source, size, source_size, target, rate, copies, taken``.  Documents of
    one source and size share a rate, so all solving happens on the histogram of (source,
    size); whole copies are dealt to cells of it by systematic rounding from long to short,
    and what is left is filled with single copies, largest that fits first.  Within a cell
    documents are served in the order of a hash of doc_id and text.  Reruns agree; repeated rows count
    as rows of their own; null text has size 0 (taken 0); null source is a source; further
    columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.monotonically_increasing_id().alias("key"), *_base("doc_id", "source", "text"))
    return _mix(base, cap, fixups, bucket_rows).drop("key")


def _base(doc_id: str, source: str, text: str) -> list[Column]:
    """What mixing needs of a document; ``h`` tells rows apart, but for equal ones."""
    return [
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("h"),
    ]


def _mix(base: DataFrame, cap: int, fixups: int = 6, bucket_rows: int = 200_000) -> DataFrame:
    """:func:`mix` over rows ``key, doc_id, source, size, h``, which keep their key."""
    base = materialize(base, "mix")
    n = base.count()
    parts = max(1, -(-n // bucket_rows))  # a cell of equal rows is served in this many parts
    base = base.withColumn("b", F.pmod("h", F.lit(parts)).cast("int"))
    fine = materialize(base.groupBy("source", "size", "b").agg(F.count("*").alias("cb")), "mix")
    sizes = fine.groupBy("source").agg(F.sum(F.col("size") * F.col("cb")).alias("source_size"), F.sum("cb").alias("n"))
    src = source_targets(sizes.select("source", "source_size"), cap=cap)
    src = materialize(src.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix")
    hist = fine.groupBy("source", "size").agg(F.sum("cb").alias("c"))
    hist = hist.join(src.select(F.col("source").alias("s"), "idx"), F.col("source").eqNullSafe(F.col("s"))).select("idx", "size", "c")
    hist = materialize(hist, "mix")
    lam = tilt(hist, src, cap)

    cell = hist.join(lam, "idx").join(src.select("idx", "target", "source_size"), "idx")
    cell = cell.withColumn(
        "rate",
        F.when(F.col("source_size") == 0, 0.0)
        .when(~F.col("open"), F.lit(float(cap)))
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("scale"))))),
    )
    by_src = W.partitionBy("idx")
    down = by_src.orderBy(F.desc("size"))
    want = F.col("c") * F.col("rate")
    cell = cell.withColumn("cum", F.sum(want).over(down.rowsBetween(W.unboundedPreceding, 0)))
    cell = cell.withColumn("k", F.floor(F.col("cum") + 0.5) - F.floor(F.col("cum") - want + 0.5))
    cell = cell.withColumn("k", F.greatest(F.lit(0), F.least(F.col("k"), cap * F.col("c"))).cast("long"))
    for _ in range(fixups):
        cell = cell.withColumn("rest", F.round(F.col("target") - F.sum(F.col("k") * F.col("size")).over(by_src)).cast("long"))
        add = (F.col("rest") > 0) & (F.col("k") < cap * F.col("c"))
        cut = (F.col("rest") < 0) & (F.col("k") > 0)
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest")) & (add | cut)
        pick = F.max(F.when(fits, F.col("size"))).over(by_src)
        m = F.floor(F.abs("rest") / F.col("size"))
        room = F.when(F.col("rest") > 0, F.least(m, cap * F.col("c") - F.col("k"))).otherwise(-F.least(m, F.col("k")))
        cell = cell.withColumn("pick", pick).withColumn(
            "k", F.when(F.col("size") == F.col("pick"), F.col("k") + room).otherwise(F.col("k"))
        )
    cell = materialize(cell.select("idx", "size", "c", "k", "rate"), "mix")

    # Deal a cell's k copies to its parts in proportion to their rows.
    part = fine.join(src.select(F.col("source").alias("s"), "idx", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    part = part.drop("s").join(cell, ["idx", "size"])
    w = W.partitionBy("idx", "size").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    # exact integer share: floor(k * rows_so_far / c) without leaving 64 bits
    q, r = F.expr("k div c"), F.col("k") % F.col("c")
    seen = F.sum("cb").over(w)
    share = lambda s: q * s + F.floor(r * s / F.col("c").cast("double") + 1e-9).cast("long")
    part = part.withColumn("seen", seen)
    part = part.withColumn("kb", share(F.col("seen")) - share(F.col("seen") - F.col("cb")))
    part = part.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("b").alias("bb"), "cb", "kb", "source_size", "target", "rate"
    )
    # Equal rows are one entry with a count, so that many of them are no large group; entries are served in hash order.
    own = ["source", "size", "b", "h", "doc_id"]
    row = W.partitionBy("source", "size", "b").orderBy(F.xxhash64("h", F.lit(7)), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    entry = base.groupBy(*own).agg(F.count("*").alias("e"))
    entry = entry.withColumn("start", F.sum("e").over(row) - F.col("e"))
    entry = entry.join(part, entry["source"].eqNullSafe(part["s"]) & (entry["size"] == part["z"]) & (entry["b"] == part["bb"]))
    more = F.greatest(F.lit(0), F.least(F.col("e"), F.col("kb") % F.col("cb") - F.col("start")))
    entry = entry.select(*[F.col(c).alias(f"{c}_") for c in own], "e", "source_size", "target", "rate", F.expr("kb div cb").alias("each"), more.alias("more"))
    entry = materialize(entry, "mix")
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    out = base.join(entry.hint("merge"), same).drop(*[f"{c}_" for c in own])
    whole = out.where("more = 0 OR more = e").withColumn("copies", F.col("each") + (F.col("more") > 0).cast("long"))
    some = _some_of_equal(out.where("more > 0 AND more < e"), own, bucket_rows)
    out = whole.unionByName(some).withColumn("copies", F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("copies")))
    return out.select(
        "key", "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _some_of_equal(rows: DataFrame, own: list[str], bucket_rows: int) -> DataFrame:
    """``copies`` of rows of which ``more`` of ``e`` equal ones get one more than ``each``: any of them, dealt by parts of the group."""
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("key"), F.ceil(F.col("e") / bucket_rows)).cast("int"))
    sizes = rows.groupBy(*own, "sub", "e", "more").agg(F.count("*").alias("cs"))
    seen = F.sum("cs").over(W.partitionBy(*own).orderBy("sub").rowsBetween(W.unboundedPreceding, 0))
    upto = lambda s: F.floor(F.col("more") * s / F.col("e").cast("double") + 1e-9).cast("long")
    sizes = sizes.withColumn("seen", seen).withColumn("due", upto(F.col("seen")) - upto(F.col("seen") - F.col("cs")))
    sizes = sizes.select(*[F.col(c).alias(f"{c}_") for c in (*own, "sub")], "due")
    rank = F.row_number().over(W.partitionBy(*own, "sub").orderBy("key"))
    same = F.lit(True)
    for c in (*own, "sub"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    got = rows.withColumn("rank", rank).join(sizes, same)
    got = got.withColumn("copies", F.col("each") + (F.col("rank") <= F.col("due")).cast("long"))
    return got.drop("rank", "due", "sub", *[f"{c}_" for c in (*own, "sub")])


def repeat_by_mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """Every document as many times as the mix takes it, columns unchanged.

    Rows are written with a key and matched to their copies by it, so repeated rows and rows
    without an id are rows of their own.  Sizes, nulls and empty tables: see :func:`mix`.
    """
    cols = docs.columns
    keyed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), F.monotonically_increasing_id().alias("key")), "keyed")
    plan = _mix(keyed.select("key", *_base("doc.doc_id", "doc.source", "doc.text")), cap).where("copies > 0").select("key", "copies")
    rows = keyed.join(plan.hint("merge"), "key")
    rows = rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in cols])
