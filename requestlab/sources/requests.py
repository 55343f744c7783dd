"""Sources and sinks of request data: Spark readers and writers with the record rules on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_SCHEMA = "request STRING, label STRING, id STRING, _bad STRING"

# Headers of a tabular log in the order they take in the request text.
HEADER_COLUMNS = (
    ("User-Agent", "request_user_agent"),
    ("Accept", "request_accept"),
    ("Accept-Encoding", "request_accept_encoding"),
    ("Accept-Language", "request_accept_language"),
    ("Host", "request_host"),
    ("Origin", "request_origin"),
    ("Referer", "request_referer"),
    ("Cookie", "request_cookie"),
    ("DNT", "request_do_not_track"),
    ("Content-Type", "request_content_type"),
    ("Connection", "request_connection"),
)


def parse_requests(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1: good rows ``request_id, request, label`` and rejected ones ``line`` of a text frame ``value``.

    Blank lines count nowhere; a line that is not a JSON object with a request is rejected.
    """
    rows = lines.where(F.trim("value") != "").select(
        "value", F.from_json("value", REQUEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    good = F.col("r._bad").isNull() & F.col("r.request").isNotNull()
    ok = rows.where(good).select(F.col("r.id").alias("request_id"), F.col("r.request").alias("request"), F.col("r.label").alias("label"))
    return ok, rows.where(~F.coalesce(good, F.lit(False))).select(F.col("value").alias("line"))


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1 over JSON-lines files."""
    return parse_requests(spark.read.text(path))


def read_request_log(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A tabular log, all columns strings."""
    return spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"', inferSchema=False)


def requests_from_columns(df: DataFrame, method: Column, target: Column, headers: list[tuple[str, Column]], proto: Column | None = None, body: Column | None = None, label: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A2: request text from log columns: request line, non-empty headers in order, Content-Length of the body (its
    UTF-8 bytes), the body itself left out."""
    line = F.concat_ws(" ", method, target, F.coalesce(proto, F.lit("HTTP/1.1")) if proto is not None else F.lit("HTTP/1.1"))
    parts = [F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in headers]
    if body is not None:
        parts.append(F.when(F.trim(body) != "", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))))
    out = {"request": F.concat_ws("\n", line, *parts)}
    if label is not None:
        out["label"] = label
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def requests_from_log(df: DataFrame) -> DataFrame:
    """A2 over the log's own column names; the normal flag gives the label."""
    return requests_from_columns(
        df,
        F.col("request_http_method"),
        F.col("request_http_request"),
        [(name, F.col(c)) for name, c in HEADER_COLUMNS],
        F.col("request_http_protocol"),
        F.col("request_body"),
        F.when(F.col("`000 - Normal`") == "1", "valid").otherwise("attack"),
    )


def requests_from_header_blob(df: DataFrame) -> DataFrame:
    """A3: headers in one column with literal backslash-n between them, ``null`` for none; ``Valid`` is valid."""

    def lines(c: str) -> Column:
        given = F.when(F.lower(F.trim(F.col(c))) == "null", F.lit("")).otherwise(F.coalesce(F.col(c), F.lit("")))
        return F.filter(F.transform(F.split(given, r"\\n"), lambda x: F.trim(x)), lambda x: x != "")

    text = F.array_join(F.concat(F.array(F.concat_ws(" ", "method", "url", F.lit("HTTP/1.1"))), lines("request_headers"), lines("custom_headers")), "\n")
    return df.select(F.col("id").alias("request_id"), text.alias("request"), F.when(F.col("label") == "Valid", "valid").otherwise("attack").alias("label"))


def write_requests_jsonl(df: DataFrame, path: str) -> None:
    """A4: labelled requests as JSON lines, non-ASCII text as it is."""
    df.write.mode("overwrite").json(path)


def write_embeddings(df: DataFrame, path: str, model: str, encoder: str, pipeline: str = "none", with_requests: bool = False) -> None:
    """A5: embeddings and labels (requests by option) as Parquet, with a metadata table beside."""
    cols = [c for c in df.columns if with_requests or c != "request"]
    df.select(*cols).write.mode("overwrite").parquet(f"{path}/embeddings")
    meta = df.agg(F.count("*").alias("count")).select("*", F.lit(model).alias("model"), F.lit(encoder).alias("encoder"), F.lit(pipeline).alias("pipeline"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5: (embeddings, metadata)."""
    return spark.read.parquet(f"{path}/embeddings"), spark.read.json(f"{path}/metadata")


BATCH_SCHEMA = "embeddings ARRAY<ARRAY<FLOAT>>, labels ARRAY<STRING>, ids ARRAY<STRING>"


def explode_embedding_batches(lines: DataFrame) -> DataFrame:
    """``id, label, embedding`` from JSON lines of batches; the header line has no embeddings and falls out."""
    got = lines.select(F.from_json("value", BATCH_SCHEMA).alias("b")).where("b.embeddings IS NOT NULL")
    zipped = F.arrays_zip(F.col("b.embeddings").alias("embedding"), F.col("b.labels").alias("label"), F.col("b.ids").alias("id"))
    return got.select(F.posexplode(zipped).alias("pos", "x")).select("x.id", "x.label", "x.embedding", "pos")


def write_predictions(df: DataFrame, path: str) -> None:
    """``request_id, prediction, label, score`` as JSON lines."""
    df.select("request_id", "prediction", "label", "score").write.mode("overwrite").json(path)


def build_corpus(normalized: DataFrame) -> DataFrame:
    """Text of valid requests, canonical where normalisation worked, raw otherwise."""
    text = F.when(F.col("error").isNull(), F.col("canonical")).otherwise(F.col("request"))
    return normalized.where("label = 'valid'").select("request_id", text.alias("text"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Documents separated by a blank line; blank lines inside a document are left out, so that it stays one."""
    corpus.select(F.concat(F.regexp_replace("text", r"\n[ \t\r]*(?=\n)|^\s*\n", ""), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document a row."""
    return spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "").select(F.regexp_replace("value", r"\n+$", "").alias("text"))


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """One small table a run, CSV by recall descending."""
    if kind == "csv":
        df.orderBy(F.desc("recall")).coalesce(1).write.mode("overwrite").csv(path, header=True)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)
