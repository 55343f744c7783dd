"""Evaluation of detectors as aggregations over ``label``, ``prediction`` and ``score``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from requestlab.functions import text as T
from requestlab.sources import store

ATTACK, VALID = "attack", "valid"


def normalize_label(c: Column) -> Column:
    """A10: attack/anomalous and valid/normal; anything else is an error."""
    return (
        F.when(c.isin("attack", "anomalous"), ATTACK)
        .when(c.isin("valid", "normal"), VALID)
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c, F.lit("null")))))
    )


def confusion_matrix(df: DataFrame, positive: str = ATTACK, by: list[str] | None = None) -> DataFrame:
    """``tp, fp, tn, fn``; any label but ``positive`` is negative; no rows is an error."""
    hit, pos = F.col("prediction"), F.coalesce(F.col("label") == positive, F.lit(False))
    counts = [
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    ]
    out = df.groupBy(*(by or [])).agg(*counts, F.count("*").alias("_n"))
    return out.withColumn("tp", F.when(F.col("_n") == 0, F.raise_error(F.lit("no rows to evaluate"))).otherwise(F.col("tp"))).drop("_n")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def classification_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, f1 (0 where undefined), accuracy, fpr, specificity beside the counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return conf.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
            "fpr": fp / F.greatest(fp + tn, F.lit(1)),
            "specificity": _ratio(tn, tn + fp),
        }
    )


#: Rank error of the brackets of :func:`percentiles` is 1 / BRACKET of the rows.
BRACKET = 10_000


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact linear percentiles ``p0, p1, ...`` of a column, one row a group; nulls do not count.

    Two passes and no buffer of a group's values.  The first finds, by quantile sketches, a bracket
    of values around each wanted rank; the second counts the rows below it and, by distinct
    value, those inside (about 6 / BRACKET of a large group), and the rank is read off those.  The brackets,
    a row a group, go to the rows, which stay where they are.  A rank outside its bracket is noticed and
    the second pass is made again over whole groups.
    """
    by = list(by or [])
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("_x"))
    keys = [f"_g{i}" for i in range(len(by))]
    near = [(s - 3 / BRACKET, s + 3 / BRACKET) for s in shares]
    sketch = F.percentile_approx("_x", [min(1.0, max(0.0, x)) for pair in near for x in pair], BRACKET)
    head = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), sketch.alias("_q"))
    head = store.materialize(head, "brackets") if keys else df.sparkSession.createDataFrame(head.collect(), head.schema)  # one row
    read = _read_ranks(rows, head, keys, shares, near)
    if not read.where("NOT (_less <= floor(_at) AND ceil(_at) < _upto)").isEmpty():
        store.discard(read)
        read = _read_ranks(rows, head, keys, shares, [(-1.0, 2.0)] * len(shares))
    exact = F.when(F.floor("_at") == F.ceil("_at"), F.col("_a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.floor("_at")) * F.col("_b"))
    out = read.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, exact)).alias(f"p{i}") for i in range(len(shares))])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *[f"p{i}" for i in range(len(shares))])


def _read_ranks(rows: DataFrame, head: DataFrame, keys: list[str], shares: list[float], near: list[tuple[float, float]]) -> DataFrame:
    """Per group and share ``_i``: the values ``_a`` and ``_b`` at the ranks around ``_at``, the rows ``_less`` than its bracket and ``_upto`` its end."""
    small = F.col("_n") <= BRACKET
    ends = [
        F.struct(
            F.when(small | F.lit(low <= 0), F.col("_lo")).otherwise(F.col("_q")[2 * i]).alias("lo"),
            F.when(small | F.lit(high >= 1), F.col("_hi")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
        )
        for i, (low, high) in enumerate(near)
    ]
    both = _beside(rows, head.select(*keys, F.array(*ends).alias("_ends")), keys)
    x, end = F.col("_x"), lambda i: F.col("_ends")[i]
    # a row below a bracket counts under no value, one above it nowhere
    place = [F.when(x < end(i)["lo"], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("x"))).when(x <= end(i)["hi"], F.struct(F.lit(i).alias("i"), x.alias("x"))) for i in range(len(shares))]
    held = both.select(*keys, F.explode(F.array_compact(F.array(*place))).alias("_s")).groupBy(*keys, F.col("_s.i").alias("_i"), F.col("_s.x").alias("_x")).agg(F.count("*").alias("_c"))
    held = _beside(held, head.select(*keys, "_n"), keys)
    upto = F.sum("_c").over(W.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_x")).rowsBetween(W.unboundedPreceding, 0))
    held = held.withColumn("_upto", upto).withColumn("_at", F.get(F.lit(list(shares)), F.col("_i")) * (F.col("_n") - 1))
    at = lambda rank: F.min(F.when(F.col("_x").isNotNull() & (F.col("_upto") > rank), F.col("_x")))
    got = held.groupBy(*keys, "_i").agg(
        at(F.floor("_at")).alias("_a"), at(F.ceil("_at")).alias("_b"), F.first("_at").alias("_at"),
        F.coalesce(F.max(F.when(F.col("_x").isNull(), F.col("_c"))), F.lit(0)).alias("_less"), F.max("_upto").alias("_upto"),
    )
    return store.materialize(got, "ranks") if keys else rows.sparkSession.createDataFrame(got.collect(), got.schema)  # a row a share


def _beside(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the one row of ``side``, a written table, that has their group; broadcast if it is counted to be small."""
    if not keys:
        return rows.crossJoin(F.broadcast(side))  # one row
    side = store.beside(side.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in side.columns if c not in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.join(side, same).drop(*[f"{k}_" for k in keys])


def percentile(df: DataFrame, value: str, share: float) -> float | None:
    """One exact percentile of all rows."""
    return percentiles(df, value, [share]).first()[0]


def threshold_at_fpr(scores: DataFrame, max_fpr: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Linear percentile 1 - max_fpr of the valid rows' scores, and the rate it really gives."""
    valid = scores.where(F.col("label") == VALID)
    cut = percentiles(valid, "score", [1 - max_fpr], by).withColumnRenamed("p0", "threshold")
    cut = store.materialize(cut, "thresholds") if by else cut
    joined = valid.join(store.beside(cut), by) if by else valid.crossJoin(F.broadcast(cut))  # one row
    rate = joined.groupBy(*(by or []), "threshold").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("actual_fpr"))
    return rate


def predict(scores: DataFrame, threshold: DataFrame | float, by: list[str] | None = None) -> DataFrame:
    """``prediction`` = score > threshold, strictly; thresholds per group if ``by``."""
    if isinstance(threshold, (int, float)):
        return scores.withColumn("prediction", F.col("score") > F.lit(float(threshold)))
    cut = threshold.select(*(by or []), "threshold")
    both = scores.join(store.beside(store.materialize(cut, "thresholds")), by, "left") if by else scores.crossJoin(F.broadcast(cut))  # one row
    return both.withColumn("prediction", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))


def metrics_at_fpr(scores: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """D3: metrics at the threshold that keeps ``max_fpr`` on valid rows."""
    cut = threshold_at_fpr(scores, max_fpr)
    conf = confusion_matrix(predict(scores, cut))
    return classification_metrics(conf).crossJoin(F.broadcast(cut.select("threshold")))  # one row


def label_counts(df: DataFrame) -> DataFrame:
    """Rows and share per label."""
    total = F.sum("n").over(W.partitionBy())
    return df.groupBy("label").agg(F.count("*").alias("n")).withColumn("ratio", F.col("n") / total)


def flag_stats(requests: DataFrame, k: int = 25) -> DataFrame:
    """Per label the k most frequent flags: total, per request, presence rate (ties by name).

    ``requests`` has ``label`` and ``all_flags``.  One pass: a request sends each of its flags once
    with its count, and one empty name that counts the request itself.
    """
    flags = F.col("all_flags")
    each = F.transform(
        F.array_distinct(flags), lambda f: F.struct(f.alias("flag"), F.size(F.filter(flags, lambda x: x == f)).cast("long").alias("c"))
    )
    own = F.array(F.struct(F.lit("").alias("flag"), F.lit(1).cast("long").alias("c")))
    rows = T.unnest(requests, F.concat(own, each), "x", "label")
    got = rows.groupBy("label", F.col("x.flag").alias("flag")).agg(F.sum("x.c").alias("total"), F.count("*").alias("n_with"))
    n = F.max(F.when(F.col("flag") == "", F.col("n_with"))).over(W.partitionBy("label"))
    got = got.withColumn("n_requests", n).where("flag <> ''")
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("total"), "flag"))
    out = got.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(
        "label", "rank", "flag", "total", (F.col("total") / F.col("n_requests")).alias("per_request"), (F.col("n_with") / F.col("n_requests")).alias("presence_rate")
    )


def nearest_rank_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, median (average of the middle two), p90, p95, p99 by nearest rank, min, max.

    Ranks are read off the counts of distinct values, so a group may be of any size.
    """
    hist = df.groupBy(by, F.col(value).alias("v")).agg(F.count(value).alias("c"))
    w = W.partitionBy(by)
    hist = hist.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col("v")))

    n = F.col("n")
    return hist.groupBy(by).agg(
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        ((at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2).alias("median"),
        *[at(F.ceil(n * p / 100)).alias(f"p{p}") for p in (90, 95, 99)],
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def score_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Moments and percentiles of ``score`` and a verdict on its variance."""
    pct = (1, 5, 10, 25, 50, 75, 90, 95, 99)
    out = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
    cuts = percentiles(df, "score", [p / 100 for p in pct], by).withColumnsRenamed({f"p{i}": f"_{p}" for i, p in enumerate(pct)})
    if by:
        same = F.lit(True)
        for c in by:
            same = same & out[c].eqNullSafe(cuts[c])
        out = out.join(cuts, same, "left").select(*[out[c] for c in out.columns], *[f"_{p}" for p in pct])
    else:
        out = out.crossJoin(F.broadcast(cuts))  # one row each
    out = out.withColumnsRenamed({f"_{p}": f"p{p}" for p in pct})
    spread = F.col("std") * F.col("std")
    return out.withColumn("variance_verdict", F.when(spread < 0.001, "very low").when(spread < 0.01, "low").otherwise("ok"))


def score_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins of ``score`` per label between the overall ends; the last end is inside; with density."""
    ends = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    both = df.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / width)).cast("int")
    got = both.withColumn("bin", F.when(F.col("hi") == F.col("lo"), 0).otherwise(b)).withColumn("width", width)
    got = got.groupBy("label", "bin", "lo", "width").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("label"))
    return got.select(
        "label",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left"),
        "n",
        F.when(F.col("width") > 0, F.col("n") / total / F.col("width")).alias("density"),
    )


def contamination_thresholds(df: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Score percentile for each contamination."""
    got = percentiles(df, "score", [1 - x for x in levels])
    pairs = F.array(*[F.struct(F.lit(x).alias("contamination"), F.col(f"p{i}").alias("threshold")) for i, x in enumerate(levels)])
    return got.select(F.explode(pairs).alias("x")).select("x.contamination", "x.threshold")


def error_overlap(joined: DataFrame, models: list[str]) -> DataFrame:
    """``kind`` (fp, fn, tp), number of models that share the row, rows."""
    pos = F.col("label") == ATTACK
    count = lambda want: sum((F.col(m) == want).cast("int") for m in models[1:]) + (F.col(models[0]) == want).cast("int")
    rows = joined.select(F.explode(F.array(
        F.struct(F.lit("fp").alias("kind"), F.when(~pos, count(True)).alias("n_models")),
        F.struct(F.lit("fn").alias("kind"), F.when(pos, count(False)).alias("n_models")),
        F.struct(F.lit("tp").alias("kind"), F.when(pos, count(True)).alias("n_models")),
    )).alias("x")).select("x.*")
    return rows.where("n_models IS NOT NULL").groupBy("kind", "n_models").agg(F.count("*").alias("n"))


def unique_catches(joined: DataFrame, models: list[str]) -> DataFrame:
    """Attacks that one model alone catches."""
    hits = sum(F.col(m).cast("int") for m in models[1:]) + F.col(models[0]).cast("int")
    only = joined.where((F.col("label") == ATTACK) & (hits == 1))
    name = F.coalesce(*[F.when(F.col(m), F.lit(m)) for m in models])
    return only.groupBy(name.alias("model")).agg(F.count("*").alias("n"))


def error_venn(joined: DataFrame, models: list[str]) -> DataFrame:
    """Region sizes of the models' FP and FN sets; bit i of ``region`` is model i."""
    pos = F.col("label") == ATTACK
    wrong = [F.when((F.col(m) & ~pos) | (~F.col(m) & pos), 1 << i).otherwise(0) for i, m in enumerate(models)]
    region = wrong[0]
    for x in wrong[1:]:
        region = region + x
    rows = joined.select(F.when(pos, "fn").otherwise("fp").alias("kind"), region.alias("region"))
    return rows.where("region > 0").groupBy("kind", "region").agg(F.count("*").alias("n"))


def agreement_matrix(joined: DataFrame, models: list[str]) -> DataFrame:
    """Percentage of rows on which two models agree, for all ordered pairs; one pass, no self-join."""
    pairs = [(a, b) for a in models for b in models]
    got = joined.agg(*[F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(f"`{a}|{b}`") * 100).alias("agreement")) for a, b in pairs])
    return got.select(F.explode(cells).alias("x")).select("x.*")


def batch_metrics(df: DataFrame, size: int, order: str = "request_id", start: str | None = None, end: str | None = None) -> DataFrame:
    """Per batch of ``size`` rows in the order of the id: rows, request length mean and population std, embedding
    norm mean and std, and with ``start`` and ``end`` (timestamps) the batch's latency in milliseconds from its first
    start to its last end; ``seen`` counts the rows up to and with the batch."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    aggs = [
        F.count("*").alias("n"),
        F.avg(F.length("request")).alias("len_mean"),
        F.stddev_pop(F.length("request")).alias("len_std"),
        F.avg(norm).alias("norm_mean"),
        F.stddev_pop(norm).alias("norm_std"),
    ]
    if start and end:
        aggs.append((F.unix_micros(F.max(end).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))).alias("_micros"))
    out = numbered(df, order, "_row").groupBy(F.floor((F.col("_row") - 1) / size).alias("batch")).agg(*aggs)
    out = out.withColumn("seen", F.sum("n").over(W.orderBy("batch")))  # a row a batch
    return out.withColumn("latency_ms", F.col("_micros") / 1000).drop("_micros") if start and end else out


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 in the order of ``order``: ranges are sorted apart and shifted by the rows of the ranges before."""
    part = df.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_part", F.spark_partition_id())
    part = store.materialize(part, "numbered")
    sizes = part.groupBy("_part").agg(F.count("*").alias("_c"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_before"))  # a row a range
    row = F.row_number().over(W.partitionBy("_part").orderBy(F.col(order).asc_nulls_first()))
    return part.withColumn(name, row).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_p", "_before")


def running_windows(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """H4: ``seen`` (rows of the key up to this one), ``repeats`` (rows of the key) and ``batch_index`` (batches of ``size`` rows)."""
    w = W.partitionBy(key)
    out = numbered(df, order, "_row").withColumn("batch_index", F.floor((F.col("_row") - 1) / size))
    out = out.withColumn("seen", F.count("*").over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("repeats", F.count("*").over(w)).drop("_row")


def run_totals(batches: DataFrame) -> DataFrame:
    """The run as a whole from its batches: batches, rows, mean length and, where measured, latency mean and maximum."""
    aggs = [F.count("*").alias("batches"), F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("len_mean")) / F.sum("n")).alias("len_mean")]
    if "latency_ms" in batches.columns:
        aggs += [F.avg("latency_ms").alias("latency_mean_ms"), F.max("latency_ms").alias("latency_max_ms")]
    return batches.agg(*aggs)


def distance_summary(df: DataFrame, value: str = "distance") -> DataFrame:
    """Distances by label and the ratio of the attack mean to the valid mean."""
    got = df.groupBy("label").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = percentiles(df, value, [0.5], ["label"]).select(F.col("label").alias("_label"), F.col("p0").alias("median"))
    got = got.join(middle, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    all_ = W.partitionBy()
    ratio = F.max(F.when(F.col("label") == ATTACK, F.col("mean"))).over(all_) / F.max(F.when(F.col("label") == VALID, F.col("mean"))).over(all_)
    return got.withColumn("attack_ratio", ratio)


def corpus_stats(docs: DataFrame, tokens: Column, long: int = 512) -> DataFrame:
    """Documents, token length mean, min, max, share of long ones, distinct tokens."""
    sized = docs.select(tokens.alias("t")).select(F.size("t").alias("n"), "t")
    head = sized.agg(
        F.count("*").alias("documents"), F.avg("n").alias("mean_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.avg((F.col("n") >= long).cast("double")).alias("long_share")
    )
    vocab = sized.select(F.explode("t").alias("term")).agg(F.countDistinct("term").alias("vocabulary"))
    return head.crossJoin(F.broadcast(vocab))  # one row each


def category_counts(df: DataFrame, categories: list[str]) -> DataFrame:
    """Rows per 0/1 column; a row may count in several."""
    got = df.agg(*[F.sum(F.col(f"`{c}`").cast("long")).alias(c) for c in categories])
    return got.unpivot([], categories, "category", "n")


def compare_runs(runs: DataFrame, metric: str, baseline) -> DataFrame:
    """Difference of a metric from the baseline run, relative and in points."""
    base = runs.where(baseline).select(F.col(metric).alias("_b")).limit(1)
    both = runs.crossJoin(F.broadcast(base))  # one row
    return both.withColumns(
        {"points": (F.col(metric) - F.col("_b")) * 100, "relative": F.when(F.col("_b") != 0, F.col(metric) / F.col("_b") - 1)}
    ).drop("_b")


def flag_lift(stats: DataFrame) -> DataFrame:
    """Presence rate attack minus valid per flag, in points; a missing side is 0."""
    got = stats.groupBy("flag").pivot("label", [ATTACK, VALID]).agg(F.first("presence_rate")).na.fill(0.0)
    return got.select("flag", ((F.col(ATTACK) - F.col(VALID)) * 100).alias("lift"))


def sweep_marginals(runs: DataFrame, parameter: str, metric: str) -> DataFrame:
    """Mean and population std of a metric per level of one parameter."""
    return runs.groupBy(F.col(parameter).alias("level")).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def compare_sweeps(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """Two sweeps side by side."""
    side = lambda d, s: d.select(key, F.col("recall").alias(f"recall_{s}"), F.col("fpr").alias(f"fpr_{s}"))
    return side(a, "a").join(side(b, "b"), key)
