"""Structured Streaming jobs: normalise, score, watch."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from requestlab.operators import normalize
from requestlab.sources import store
from requestlab.sources.requests import parse_requests


def stream_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """New JSON-lines files as (requests, rejected lines)."""
    return parse_requests(spark.readStream.text(path))


def stream_normalize(requests: DataFrame) -> DataFrame:
    """Normalisation of a streaming frame; stateless, so the batch job serves as it is."""
    return normalize.normalize_requests(requests)


def stream_score(vectors: DataFrame, detector, threshold: float | None = None) -> DataFrame:
    """``score`` and ``prediction`` with a fitted model sent to the tasks."""
    return detector.predict(vectors, threshold)


class BatchLog(StreamingQueryListener):
    """What a stream reports of its batches: rows seen by the observation ``name`` and the time each batch took.

    A listener of the session: ``spark.streams.addListener(log)``.  It keeps the last ``keep`` batches and running
    totals, so it may watch a stream for ever; batches without rows are not counted.
    """

    def __init__(self, name: str = "batch", keep: int = 1000):
        self.name, self.batches, self.ended = name, deque(maxlen=keep), threading.Event()
        self.total = {"batches": 0, "rows": 0, "latency_ms": 0.0, "latency_max_ms": 0.0}

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        rows = seen["rows"] if seen is not None else 0
        if rows:
            took = float(p.durationMs.get("triggerExecution", 0))
            self.batches.append({"batch": p.batchId, "rows": rows, "latency_ms": took, "rows_per_second": 1000 * rows / took if took else None})
            t = self.total
            t["batches"], t["rows"], t["latency_ms"] = t["batches"] + 1, t["rows"] + rows, t["latency_ms"] + took
            t["latency_max_ms"] = max(t["latency_max_ms"], took)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def totals(self, wait: float = 30) -> dict:
        """Batches, rows, mean and largest latency so far; once a stream has ended, of all it did."""
        self.ended.wait(wait)
        t = self.total
        return {"batches": t["batches"], "rows": t["rows"], "latency_mean_ms": t["latency_ms"] / t["batches"] if t["batches"] else None, "latency_max_ms": t["latency_max_ms"]}


def stream_batch_metrics(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """S3: D13 for each micro-batch, handed to ``sink(metrics, batch_id)``; rows are observed as ``batch`` for a :class:`BatchLog`.

    Embedding norms are summed up where the stream has ``embedding``; totals of the run come from
    ``metrics.run_totals`` over what the sink kept, latencies from the listener.
    """
    watched = stream.observe("batch", F.count("*").alias("rows"))
    aggs = [F.count("*").alias("n"), F.avg(F.length("request")).alias("len_mean"), F.stddev_pop(F.length("request")).alias("len_std")]
    if "embedding" in stream.columns:
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        aggs += [F.avg(norm).alias("norm_mean"), F.stddev_pop(norm).alias("norm_std")]

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(batch.agg(*aggs), batch_id)

    return watched.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flag_rate_monitor(normalized: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Flags per family and tumbling window of ``ts``.

    In append and update mode rows later than the watermark are dropped, and append gives no window
    before the watermark has passed it; complete mode (`run_complete`) counts every row that has a ``ts``.
    """
    timed = normalized.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    flags = normalize.extract_flags(timed, keys=("request_id", "ts"))
    family = normalize.family_of(F.col("flag")).alias("family")
    return flags.groupBy(F.window("ts", window).alias("w"), family).agg(F.count("*").alias("n_flags")).select(
        F.col("w.start").alias("window_start"), "family", "n_flags"
    )


def run_complete(stream: DataFrame, path: str) -> DataFrame:
    """Run an aggregated stream over what is there now in complete mode and return its last state, open windows included.

    Every batch replaces its own folder below ``path``, so a repeated batch is written once.
    """
    spark, last = stream.sparkSession, []

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id}")
        last[:] = [batch_id]

    writer = stream.writeStream.foreachBatch(each).outputMode("complete").option("checkpointLocation", f"{path}-state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def flag_rate_job(normalized: DataFrame, path: str, window: str = "10 minutes", late: str = "10 minutes"):
    """S4 for ever: flags per family and window in bounded state, late rows beside them; returns the started query.

    The watermark of a batch is the largest ``ts`` of the batches before it less ``late``, as Spark's is.  Rows of
    windows that it has passed are late: they go to ``<path>/late``.  All others are added to the open
    windows, one row a window and family in ``<path>/open/<batch>``; windows that the next watermark has passed
    leave it for ``<path>/closed``.  So what is kept between batches is the open windows, whatever the stream's length.
    Every batch writes folders of its own number, so one that is repeated replaces what it wrote.
    Rows without a ``ts`` are in no window.
    """
    span, delay = F.expr(f"INTERVAL {window}"), F.expr(f"INTERVAL {late}")
    spark, name = normalized.sparkSession, lambda kind, batch: f"{path}/{kind}/batch={batch}"
    counts = "window_start timestamp, family string, n_flags long"

    def each(batch: DataFrame, batch_id: int) -> None:
        # one pass over the requests: rows without a flag have a null family, as they move the watermark as well
        family = F.explode_outer("families").alias("family")
        rows = batch.where("ts IS NOT NULL").select("ts", F.window("ts", window)["start"].alias("window_start"), family)
        rows = rows.groupBy("window_start", "family").agg(F.count("family").alias("n_flags"), F.max("ts").alias("top"))
        seen = store.materialize(rows, "flag-counts")
        top = seen.agg(F.max("top").alias("ts"))
        if batch_id:
            before = spark.read.schema("ts timestamp").parquet(name("mark", batch_id - 1))
            held = spark.read.schema(counts).parquet(name("open", batch_id - 1))
        else:
            before, held = spark.createDataFrame([], "ts timestamp"), spark.createDataFrame([], counts)
        old = before.first()
        old = old["ts"] if old else None
        before.unionByName(top).agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").coalesce(1).write.mode("overwrite").parquet(name("mark", batch_id))
        new = spark.read.schema("ts timestamp").parquet(name("mark", batch_id)).first()
        new = new["ts"] if new else None
        rows = seen.where("family IS NOT NULL").drop("top")
        passed = lambda mark: F.lit(False) if mark is None else F.col("window_start") + span <= F.lit(mark) - delay
        rows.where(passed(old)).coalesce(1).write.mode("overwrite").parquet(name("late", batch_id))
        now = held.unionByName(rows.where(~passed(old))).groupBy("window_start", "family").agg(F.sum("n_flags").alias("n_flags"))
        now = store.materialize(now, "flag-windows")
        now.where(passed(new)).coalesce(1).write.mode("overwrite").parquet(name("closed", batch_id))
        now.where(~passed(new)).coalesce(1).write.mode("overwrite").parquet(name("open", batch_id))
        store.discard(seen, now)
        for kind in ("open", "mark"):  # the batch before may be repeated, older ones are not
            if batch_id > 1:
                store.remove(spark, name(kind, batch_id - 2))

    # a batch is read as it stands, so only what is counted goes into it
    counted = normalize.all_flags(normalized).select(F.col("ts").cast("timestamp").alias("ts"), F.transform("all_flags", normalize.family_of).alias("families"))
    writer = counted.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}-state")
    return writer.trigger(availableNow=True).start()


def flag_rates(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`flag_rate_job` has counted: ``window_start, family, n_flags, n_late``; windows still open as they stand."""
    kinds = "window_start timestamp, family string, n_flags long, batch int"
    read = lambda kind: spark.read.schema(kinds).parquet(f"{path}/{kind}")
    last = read("open").agg(F.max("batch")).first()[0]
    whole = read("closed").drop("batch").unionByName(read("open").where(F.col("batch") == F.lit(last)).drop("batch"))
    both = whole.withColumn("n_late", F.lit(0)).unionByName(read("late").select("window_start", "family", F.lit(0).alias("n_flags"), F.col("n_flags").alias("n_late")))
    return both.groupBy("window_start", "family").agg(F.sum("n_flags").alias("n_flags"), F.sum("n_late").alias("n_late"))


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it wrote (memory table ``name``)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


