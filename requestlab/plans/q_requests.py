"""Registered queries: sources, sinks and request normalisation."""

from __future__ import annotations

import html.entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requestlab.functions import text as T
from requestlab.operators import metrics, normalize, query_v2
from requestlab.sources import requests as R
from requestlab.sources import store

from .tables import REQUESTS_SQL, requests, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Well-formed requests cut into parts, for SQL twins.
BASE = f"""WITH req AS ({REQUESTS_SQL}),
cut AS (SELECT *, string_split(split_part(request, chr(10), 1), ' ') AS parts FROM req),
good AS (SELECT request_id, ts, label, request, parts[1] AS method, split_part(parts[2], '?', 1) AS path,
    CASE WHEN contains(parts[2], '?') THEN substr(parts[2], strpos(parts[2], '?') + 1) END AS query
  FROM cut WHERE len(parts) = 3 AND starts_with(parts[3], 'HTTP/')),
tok AS (SELECT request_id, label, t AS token, row_number() OVER (PARTITION BY request_id) AS pos
  FROM (SELECT request_id, label, unnest(string_split(query, '&')) AS t FROM good WHERE query IS NOT NULL) WHERE t <> ''),
lines AS (SELECT request_id, label, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT request_id, label, string_split(request, chr(10))[2:] AS l FROM good)),
isle AS (SELECT *, regexp_matches(line, '^[ \\t]') AS more,
    sum(CASE WHEN regexp_matches(line, '^[ \\t]') THEN 0 ELSE 1 END) OVER (PARTITION BY request_id ORDER BY pos) AS hno FROM lines),
unf AS (SELECT request_id, label, hno, string_agg(CASE WHEN more THEN ltrim(line) ELSE line END, ' ' ORDER BY pos) AS text, bool_or(more) AS fold
  FROM isle GROUP BY ALL),
hdr AS (SELECT *, trim(split_part(text, ':', 1)) AS given, lower(trim(split_part(text, ':', 1))) AS name, substr(text, strpos(text, ':') + 1) AS value FROM unf),
ent AS (SELECT request_id, label, name, count(*) AS many, bool_or(fold) AS fold,
    CASE WHEN count(*) > 1 AND name IN ('accept', 'accept-encoding', 'accept-language', 'cache-control', 'pragma', 'link', 'www-authenticate')
      THEN string_agg(value, ', ' ORDER BY hno) ELSE max(value) END AS value
  FROM hdr GROUP BY request_id, label, name)
"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def good(spark: SparkSession, sf_dir: str, *steps) -> DataFrame:
    """Well-formed requests after some steps."""
    df = normalize.parse_request_line(requests(spark, sf_dir))
    return normalize.apply_steps(normalize.reject(df)[0], steps)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_requests(requests(spark, sf_dir)).where("error IS NULL")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a sink in the cluster's shared folder."""
    return store.fresh(spark, name)


def joined(c):
    return F.array_join(c, " ")


# ---- A -----------------------------------------------------------------------------------


@query("""SELECT coalesce(label, 'rejected') AS kind, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' THEN 'attack' ELSE 'valid' END AS label
  FROM events WHERE event_id % 31 <> 0) GROUP BY 1""")
def a1_read_requests(spark, sf_dir):
    raw = requests(spark, sf_dir).withColumn("id", F.col("request_id").cast("string"))
    line = F.when(F.col("request_id") % 31 == 0, " ").when(F.col("request_id") % 50 == 0, '{"request": broken').otherwise(
        F.to_json(F.struct("id", "request", "label"))
    )
    ok, bad = R.parse_requests(raw.select(line.alias("value")))
    kinds = ok.select(F.col("label").alias("kind")).unionByName(bad.select(F.lit("rejected").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id AS request_id, concat_ws(chr(10),
  concat('GET ', CASE WHEN p = '' THEN '/' ELSE p END, ' HTTP/1.1'), concat('Host: ', h), 'Accept: */*', concat('Content-Length: ', strlen(html))) AS request
FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS p FROM pages)""")
def a2_requests_from_columns(spark, sf_dir):
    return page_requests(spark, sf_dir).select("request_id", "request")


def page_requests(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    target = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1)
    return R.requests_from_columns(
        p.withColumn("request_id", F.col("page_id")),
        F.lit("GET"),
        F.when(target == "", "/").otherwise(target),
        [("Host", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)), ("Origin", F.lit(" ")), ("Accept", F.lit("*/*"))],
        body=F.col("html"),
        keep=("request_id",),
    )


@query(r"""SELECT CAST(event_id AS VARCHAR) AS request_id, concat_ws(chr(10), concat('GET /', event_type, ' HTTP/1.1'), 'Host: a.b', concat('X-User: ', user_id)) AS request,
  CASE WHEN event_type = 'error' THEN 'attack' ELSE 'valid' END AS label FROM events""")
def a3_requests_from_header_blob(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    blob = e.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "error", "Anomalous").otherwise("Valid").alias("label"),
        F.lit("GET").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("url"),
        F.lit(r" Host: a.b \n\n").alias("request_headers"),
        F.when(F.col("event_id") < 0, F.lit("null")).otherwise(F.concat(F.lit(r"X-User: "), F.col("user_id").cast("string"), F.lit(r"\n"))).alias("custom_headers"),
    )
    return R.requests_from_header_blob(blob)


@query(f"SELECT label, count(*) AS n, sum(length(request)) AS chars FROM ({REQUESTS_SQL}) GROUP BY label")
def a4_write_requests_jsonl(spark, sf_dir):
    path = folder(spark, "a4")
    R.write_requests_jsonl(requests(spark, sf_dir).select(F.col("request_id").cast("string").alias("id"), "request", "label"), path)
    back, _ = R.read_requests(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("request")).alias("chars"))


@query("""SELECT label, count(*) AS n, round(sum(embedding[1]), 4) AS s, any_value(c) AS count FROM embeddings, (SELECT count(*) AS c FROM embeddings) GROUP BY label""")
def a5_embeddings_artifact(spark, sf_dir):
    path = folder(spark, "a5")
    R.write_embeddings(table(spark, sf_dir, "embeddings"), path, "given", "table")
    df, meta = R.read_embeddings(spark, path)
    return df.crossJoin(F.broadcast(meta.select("count"))).groupBy("label").agg(  # one row
        F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("s"), F.first("count").alias("count")
    )


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def a6_explode_embedding_batches(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cell = F.sort_array(F.collect_list(F.struct("vec_id", "label", "embedding")))
    batches = e.groupBy(F.floor(F.col("vec_id") / 64).alias("b")).agg(cell.alias("x"))  # 64 rows a batch
    line = F.to_json(
        F.struct(
            F.transform("x", lambda x: x["embedding"]).alias("embeddings"),
            F.transform("x", lambda x: x["label"].cast("string")).alias("labels"),
            F.transform("x", lambda x: x["vec_id"].cast("string")).alias("ids"),
        )
    )
    head = spark.sql("""SELECT '{"model": "given", "dims": 64}' AS value""")
    out = R.explode_embedding_batches(batches.select(line.alias("value")).unionByName(head))
    return out.select("id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("SELECT CASE WHEN label = 9 THEN 'attack' ELSE 'valid' END AS label, embedding[1] > 0.1 AS prediction, count(*) AS n FROM embeddings GROUP BY ALL")
def a8_write_predictions(spark, sf_dir):
    path = folder(spark, "a8")
    e = table(spark, sf_dir, "embeddings")
    R.write_predictions(
        e.select(
            F.col("vec_id").alias("request_id"),
            F.when(F.col("label") == 9, "attack").otherwise("valid").alias("label"),
            (F.col("embedding")[0] > F.lit(0.1)).alias("prediction"),
            F.col("embedding")[0].alias("score"),
        ),
        path,
    )
    return spark.read.schema("request_id long, prediction boolean, label string, score double").json(path).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query(f"""{BASE} SELECT first_line, count(*) AS n FROM (SELECT concat('[METHOD] ', method, CASE WHEN method = 'PROPFIND' THEN ' UNUSUAL_METHOD' ELSE '' END) AS first_line FROM good WHERE label = 'valid'
UNION ALL SELECT split_part(request, chr(10), 1) FROM cut WHERE label = 'valid' AND len(parts) <> 3) GROUP BY 1""")
def a9_corpus(spark, sf_dir):
    """Documents of the corpus by their first line: canonical text, or the raw one of rejected requests."""
    path = folder(spark, "a9")
    R.write_corpus(R.build_corpus(normalize.normalize_requests(requests(spark, sf_dir))), path)
    return R.read_corpus(spark, path).groupBy(F.substring_index("text", "\n", 1).alias("first_line")).agg(F.count("*").alias("n"))


@query("SELECT CASE event_type WHEN 'error' THEN 'attack' ELSE 'valid' END AS label, count(*) AS n FROM events GROUP BY 1")
def a10_normalize_label(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    word = (
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "anomalous")
        .when(F.col("event_type") == "error", "attack")
        .when(F.col("event_id") % 2 == 0, "normal")
        .otherwise("valid")
    )
    return e.select(metrics.normalize_label(word).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT event_type AS run, CAST(count(*) AS DOUBLE) AS recall FROM events GROUP BY 1")
def a11_result_sink(spark, sf_dir):
    path = folder(spark, "a11")
    R.write_results(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").cast("double").alias("recall")), path, "csv")
    return spark.read.schema("run string, recall double").csv(path, header=True)


# ---- B -----------------------------------------------------------------------------------

_FRAMED = "concat(CASE event_id % 3 WHEN 0 THEN chr(65279) ELSE '' END, CASE event_id % 2 WHEN 0 THEN chr(1) ELSE '' END, chr(9), event_type, CASE event_id % 5 WHEN 0 THEN chr(2) ELSE chr(10) END)"


def framed(spark, sf_dir):
    made = _FRAMED.replace("chr(65279)", "decode(unhex('EFBBBF'), 'UTF-8')")
    return spark.sql(f"SELECT event_id AS request_id, {made} AS request FROM {{events}}", events=table(spark, sf_dir, "events"))


@query(rf"""SELECT event_id AS request_id, regexp_replace(regexp_replace({_FRAMED}, '^\x{{FEFF}}?[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]*', ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]*$', '') AS request FROM events""")
def b1_trim_framing(spark, sf_dir):
    return framed(spark, sf_dir).select("request_id", T.trim_framing(F.col("request")).alias("request"))


@query("""SELECT event_id % 3 = 0 AS bom, event_id % 2 = 0 OR event_id % 5 = 0 AS edge, count(*) AS n FROM events GROUP BY ALL""")
def b33_framing_flags(spark, sf_dir):
    f = framed(spark, sf_dir).select(T.framing_flags(F.col("request")).alias("f"))
    return f.groupBy(F.array_contains("f", "BOMREMOVED").alias("bom"), F.array_contains("f", "EDGECTRLREMOVED").alias("edge")).agg(F.count("*").alias("n"))


@query(f"""{BASE} SELECT request_id, method, path, query, CASE WHEN method NOT IN ('GET','POST','PUT','DELETE','PATCH','OPTIONS','HEAD','TRACE','CONNECT') THEN 'UNUSUAL_METHOD' ELSE '' END AS flags, NULL::VARCHAR AS error FROM good
UNION ALL SELECT request_id, NULL, NULL, NULL, '', concat('expected 3 parts, got ', len(parts)) FROM cut WHERE len(parts) <> 3""")
def b2_parse_request_line(spark, sf_dir):
    return normalize.parse_request_line(requests(spark, sf_dir)).select("request_id", "method", "path", "query", joined("flags").alias("flags"), "error")


_ENT = "concat('a=1&amp;b=', event_type, '&#38;c&#x26;d&', 'e=', event_id, '&&copy&f')"


@query(f"""SELECT event_id AS request_id, list_aggregate(list_filter(list_transform(string_split(regexp_replace({_ENT}, '&(#[0-9]+;|#x[0-9a-fA-F]+;|[a-zA-Z]+;)', chr(1) || '\\1', 'g'), '&'), lambda x: replace(x, chr(1), '&')), lambda x: x <> ''), 'string_agg', '|') AS tokens FROM events""")
def b3_split_query_entities(spark, sf_dir):
    q = spark.sql(f"SELECT event_id AS request_id, {_ENT} AS query FROM {{events}}", events=table(spark, sf_dir, "events"))
    return q.select("request_id", F.array_join(T.split_query_entities(F.col("query")), "|").alias("tokens"))


@query(f"{BASE} SELECT request_id, pos, line FROM lines")
def b4_extract_headers(spark, sf_dir):
    df = good(spark, sf_dir, normalize.header_lines)
    return T.unnest(df, "header_lines", "line", "request_id", pos="p").select("request_id", (F.col("p") + 1).cast("long").alias("pos"), "line")


@query(f"{BASE} SELECT request_id, hno AS pos, text, CASE WHEN fold THEN 'OBSFOLD' ELSE '' END AS flags FROM unf")
def b5_unfold_headers(spark, sf_dir):
    df = good(spark, sf_dir, normalize.header_lines, normalize.unfold_headers)
    return T.unnest(df, "unfolded", "h", "request_id", pos="p").select(
        "request_id", (F.col("p") + 1).cast("long").alias("pos"), "h.text", joined("h.flags").alias("flags")
    )


HEADER_STEPS = (normalize.header_lines, normalize.unfold_headers, normalize.normalize_headers)


@query(f"""{BASE} SELECT request_id, name, value, concat_ws(' ', CASE WHEN many > 1 THEN 'DUPHDR' END, CASE WHEN many > 1 AND name = 'accept' THEN 'HDRMERGE' END,
  CASE WHEN name IN ('connection','te','upgrade','trailer') THEN 'HOPBYHOP' END, CASE WHEN fold THEN 'OBSFOLD' END) AS flags FROM ent""")
def b6_normalize_headers(spark, sf_dir):
    df = good(spark, sf_dir, *HEADER_STEPS)
    return T.unnest(df, "headers", "h", "request_id").select("request_id", "h.name", "h.value", joined("h.flags").alias("flags"))


@query(f"""{BASE} SELECT request_id, count(*) AS h_count, count(*) FILTER (many > 1) AS dup_names, CAST(bool_or(name IN ('connection','te','upgrade','trailer')) AS INT) AS hopbyhop,
  0 AS bad_names, sum(length(value)) AS total_bytes FROM ent GROUP BY request_id""")
def b7_header_aggregates(spark, sf_dir):
    return good(spark, sf_dir, *HEADER_STEPS).select("request_id", "hagg.*")


@query(f"""{BASE} SELECT request_id, name, trim(regexp_replace(value, '[ \\t]+', ' ', 'g')) AS value, regexp_matches(value, '  |\\t') AS padded FROM ent""")
def b8_collapse_header_ws(spark, sf_dir):
    df = good(spark, sf_dir, *HEADER_STEPS, normalize.collapse_header_ws)
    return T.unnest(df, "headers", "h", "request_id").select("request_id", "h.name", "h.value", F.array_contains("h.flags", "WSPAD").alias("padded"))


_DANGER = """concat_ws(' ', CASE WHEN regexp_matches(c, '[<>]|%3[CcEe]') THEN 'ANGLE' END, CASE WHEN regexp_matches(c, '\\\\|%5[Cc]') THEN 'BACKSLASH' END,
  CASE WHEN regexp_matches(c, '[{}]|%7[BbDd]') THEN 'BRACE' END, CASE WHEN regexp_matches(c, '\\x00|%00') THEN 'NUL' END, CASE WHEN regexp_matches(c, '[()]|%2[89]') THEN 'PAREN' END,
  CASE WHEN regexp_matches(c, '\\||%7[Cc]') THEN 'PIPE' END, CASE WHEN q AND regexp_matches(c, '\\x00|%00') THEN 'QNUL' END,
  CASE WHEN regexp_matches(c, '[''"]|%2[27]') THEN 'QUOTE' END, CASE WHEN regexp_matches(c, ';|%3[Bb]') THEN 'SEMICOLON' END, CASE WHEN regexp_matches(c, ' |%20') THEN 'SPACE' END)""".replace("\\\\|%5", "\\\\\\\\|%5").replace("\\\\\\\\|%5", "\\\\|%5")


@query(f"""{BASE} SELECT request_id, part, pos, {_DANGER} AS flags FROM (SELECT request_id, 'path' AS part, 0 AS pos, path AS c, false AS q FROM good
UNION ALL SELECT request_id, 'query', pos, token, true FROM tok)""")
def b9_flag_dangerous_chars(spark, sf_dir):
    df = good(spark, sf_dir, normalize.split_query, *HEADER_STEPS, normalize.flag_dangerous)
    path = df.select("request_id", F.lit("path").alias("part"), F.lit(0).cast("long").alias("pos"), joined("path_flags").alias("flags"))
    par = T.unnest(df, "params", "x", "request_id", pos="p")
    return path.unionByName(par.select("request_id", F.lit("query").alias("part"), (F.col("p") + 1).cast("long").alias("pos"), joined("x.flags").alias("flags")))


@query("""SELECT doc_id, (CAST(regexp_matches(t, '[A-Za-z]') AS INT) + CAST(regexp_matches(t, '[\\x{0400}-\\x{04FF}]') AS INT) + CAST(regexp_matches(t, '[\\x{0391}-\\x{03A9}]') AS INT)) >= 2 AS mixed
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat(text, chr(1078)) ELSE concat(chr(937), chr(1078)) END AS t FROM documents)""")
def b10_flag_mixed_script(spark, sf_dir):
    t = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat(text, decode(unhex('D0B6'), 'UTF-8')) ELSE concat(decode(unhex('CEA9'), 'UTF-8'), decode(unhex('D0B6'), 'UTF-8')) END"
    return table(spark, sf_dir, "documents").select("doc_id", T.mixed_script(F.expr(t)).alias("mixed"))


@query(f"""{BASE} SELECT request_id, CASE WHEN contains(request, 'Host: ') THEN concat('http://shop.example.com', path) END AS url_abs, NOT contains(request, 'Host: ') AS badhost FROM good""")
def b11_absolute_url(spark, sf_dir):
    df = good(spark, sf_dir, *HEADER_STEPS, normalize.collapse_header_ws, lambda d: normalize.absolute_url(d, wide=False))
    return df.select("request_id", "url_abs", F.array_contains("flags", "BADHOST").alias("badhost"))



_BY_HOST = "CASE WHEN {0} <> 3 THEN concat('http://', {1}) END, CASE WHEN {0} = 3 THEN 'BADHOST' ELSE '{2}' END"  # names with three dots are taken for addresses


@query(f"""WITH p AS (SELECT *, length(h) - length(replace(h, '.', '')) AS dots FROM (SELECT page_id, url, split_part(url, '/', 3) AS h, concat('/', split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*', ''), '?', 1), '/', 2)) AS path FROM pages))
SELECT page_id, 'absolute' AS form, url AS url_abs, '' AS flags FROM p UNION ALL SELECT page_id, 'mismatch', url, 'HOSTMISMATCH' FROM p UNION ALL SELECT page_id, 'authority', concat(h, ':443'), '' FROM p UNION ALL SELECT page_id, 'nohost', NULL, 'BADHOST' FROM p
UNION ALL SELECT page_id, 'origin', {_BY_HOST.format("dots", "h, path", "")} FROM p UNION ALL SELECT page_id, 'asterisk', {_BY_HOST.format("dots", "h, '/*'", "")} FROM p
UNION ALL SELECT page_id, 'port', {_BY_HOST.format("dots", "h, ':8080', path", "")} FROM p UNION ALL SELECT page_id, 'idna', {_BY_HOST.format("dots + 1", "'xn--bcher-kva.', h, path", "IDNA")} FROM p""")
def b11_url_forms(spark, sf_dir):
    """Every page asked for in each form of a request target: by path, whole, with another host, by authority, as *, with a port, without a host, under a name that needs encoding."""
    url, h = F.col("url"), F.split_part("url", F.lit("/"), F.lit(3))
    path = F.concat(F.lit("/"), F.split_part(F.split_part(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), F.lit("?"), F.lit(1)), F.lit("/"), F.lit(2)))
    get = lambda form, target, host, method="GET": F.struct(F.lit(form).alias("form"), F.lit(method).alias("method"), target.alias("path"), host.alias("host"))
    asked = F.array(
        get("origin", path, h), get("absolute", url, h), get("mismatch", url, F.lit("other.example.com")), get("authority", F.concat(h, F.lit(":443")), h, "CONNECT"),
        get("asterisk", F.lit("*"), h, "OPTIONS"), get("port", path, F.concat(h, F.lit(":8080"))), get("nohost", path, F.lit(None).cast("string")), get("idna", path, F.concat(F.lit("b\u00fccher."), h)),
    )
    df = table(spark, sf_dir, "pages").select("page_id", F.explode(asked).alias("x"))
    header = F.when(F.col("x.host").isNotNull(), F.array(F.struct(F.lit("host").alias("name"), F.col("x.host").alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    df = df.select("page_id", F.col("x.form").alias("asked"), F.col("x.method").alias("method"), F.col("x.path").alias("path"), header.alias("headers"), T.no_flags().alias("flags"))
    other = F.col("asked") == "idna"
    both = normalize.absolute_url(df.where(~other), wide=False).unionByName(normalize.absolute_url(df.where(other)))
    return both.select("page_id", F.col("asked").alias("form"), "url_abs", joined("flags").alias("flags"))


_HOSTS = """(SELECT page_id, h, unnest([h, replace(h, '.', '..'), concat('-', h), split_part(h, '.', 1), concat(split_part(h, '.', 2), '.', split_part(h, '.', 3)), concat(page_id % 300, '.', page_id % 256, '.7.', page_id % 270),
  concat('[', format('{:x}', page_id), '::', format('{:x}', page_id * 31), ']'), concat('[', format('{:x}', page_id), '::1::2]')]) AS host FROM (SELECT page_id, split_part(url, '/', 3) AS h FROM pages))"""


@query(f"""SELECT page_id, host, CASE WHEN starts_with(host, '[') THEN NOT regexp_matches(host, '::.*::') WHEN length(host) - length(replace(host, '.', '')) = 3 THEN
  regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') AND coalesce(list_max(list_transform(string_split(host, '.'), lambda x: TRY_CAST(x AS INT))), 999) <= 255
  ELSE contains(host, '.') AND NOT contains(host, '..') AND regexp_matches(host, '^[A-Za-z0-9]') END AS ok FROM {_HOSTS}""")
def b12_validate_host(spark, sf_dir):
    """Hosts of the pages, with doubled dots, a hyphen in front, single and two labels, and addresses from their ids."""
    h = F.split_part("url", F.lit("/"), F.lit(3))
    part = lambda i: F.split_part("h", F.lit("."), F.lit(i))
    n = F.col("page_id")
    hexed = lambda c: F.lower(F.hex(c))
    cell = F.array(
        F.col("h"), F.replace("h", F.lit("."), F.lit("..")), F.concat(F.lit("-"), "h"), part(1), F.concat_ws(".", part(2), part(3)), F.concat_ws(".", n % 300, n % 256, F.lit("7"), n % 270),
        F.concat(F.lit("["), hexed(n), F.lit("::"), hexed(n * 31), F.lit("]")), F.concat(F.lit("["), hexed(n), F.lit("::1::2]")),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", h.alias("h"))
    return pages.select("page_id", F.explode(cell).alias("host")).withColumn("ok", normalize.host_is_valid(F.col("host")))


_UNI = "concat('/', CASE event_id % 6 WHEN 0 THEN chr(65313) WHEN 1 THEN chr(8203) WHEN 2 THEN chr(119808) WHEN 3 THEN chr(57344) WHEN 4 THEN '%00' ELSE 'x' END)"


def unicode_paths(spark, sf_dir):
    c = {0: "Ａ", 1: "​", 2: "\U0001d400", 3: "", 4: "%00", 5: "x"}
    pick = F.element_at(F.lit(list(c.values())), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("/"), pick).alias("path"))


@query("""SELECT event_id AS request_id, CASE event_id % 6 WHEN 0 THEN 'FULLWIDTH' WHEN 1 THEN 'UNICODE_FORMAT' WHEN 2 THEN 'FULLWIDTH MATH_UNICODE' WHEN 3 THEN 'INVALID_UNICODE' WHEN 4 THEN 'CONTROL' ELSE '' END AS flags,
  CASE event_id % 6 WHEN 0 THEN '/A' WHEN 1 THEN concat('/', chr(8203)) WHEN 2 THEN '/A' WHEN 3 THEN concat('/', chr(57344)) WHEN 4 THEN '/%00' ELSE '/x' END AS path FROM events""")
def b13_b14_unicode_nfkc(spark, sf_dir):
    df = unicode_paths(spark, sf_dir).withColumns({"params": F.expr("cast(array() as array<struct<text:string,flags:array<string>>>)"), "path_flags": T.no_flags()})
    other = F.col("path").rlike(r"[^\x00-\x7F]")
    df = normalize.nfkc_parts(df.where(~other), wide=False).unionByName(normalize.nfkc_parts(df.where(other)))
    return df.select("request_id", joined("path_flags").alias("flags"), "path")


@query("""SELECT doc_id, md5(concat('/', t)) AS path, CASE WHEN t = '' THEN '' ELSE 'FULLWIDTH' END AS flags, length(t) + 1 AS n FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def b14_nfkc_texts(spark, sf_dir):
    """The letters of whole texts, written in full width: NFKC brings them back."""
    plain = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    path = F.concat(F.lit("/"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), plain, wide))
    df = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", path.alias("path"))
    df = normalize.nfkc_parts(df.withColumns({"params": F.expr("cast(array() as array<struct<text:string,flags:array<string>>>)"), "path_flags": T.no_flags()}))
    return df.select("doc_id", F.md5("path").alias("path"), joined("path_flags").alias("flags"), F.length("path").cast("long").alias("n"))


@query(f"""{BASE} SELECT request_id, token, replace(regexp_replace(replace(replace(replace(replace(token, '%00', chr(1)), '%20', chr(2)), '%C3', chr(195)), '%A9', chr(169)), 'zzz', ''), chr(1), '%00').replace(chr(2), '%20') AS decoded,
  concat_ws(' ', CASE WHEN contains(token, '%00') THEN 'PCTNULL' END, CASE WHEN contains(token, '%20') THEN 'PCTSPACE' END) AS flags FROM tok""")
def b15_percent_decode_once(spark, sf_dir):
    df = T.unnest(good(spark, sf_dir, normalize.split_query), "tokens", "token", "request_id")
    dec = T.percent_decode_once(F.col("token"), "QUERY")
    return df.withColumn("decoded", dec).select("request_id", "token", "decoded", joined(T.percent_flags(F.col("decoded"), "QUERY")).alias("flags"))


_NAMED = sorted(html.entities.html5)
_ENTITY = f"""(regexp_matches(x, '&(#[0-9]|#[xX][0-9a-fA-F]|{"|".join(n for n in _NAMED if not n.endswith(";"))})') OR list_has_any(regexp_extract_all(x, '&([A-Za-z0-9]{{1,32}};)', 1), string_split('{" ".join(n for n in _NAMED if n.endswith(";"))}', ' ')))"""


@query(f"""SELECT page_id, part, {_ENTITY} AS entity FROM (SELECT page_id, 'html' AS part, html AS x FROM pages UNION ALL SELECT page_id, 'url', url FROM pages UNION ALL SELECT page_id, 'word', concat('&', regexp_extract(html, '<a href="/([^"]*)', 1), ';') FROM pages)""")
def b16_html_entity_flag(spark, sf_dir):
    """Pages, their addresses, and a word of theirs put as an entity."""
    word = F.concat(F.lit("&"), F.regexp_extract("html", '<a href="/([^"]*)', 1), F.lit(";"))
    parts = F.array(*[F.struct(F.lit(n).alias("part"), c.alias("x")) for n, c in (("html", F.col("html")), ("url", F.col("url")), ("word", word))])
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(parts).alias("p"))
    return pages.select("page_id", "p.part", T.has_html_entity(F.col("p.x")).alias("entity"))


QUERY_STEPS = (normalize.split_query, *HEADER_STEPS, normalize.flag_dangerous, normalize.percent_decode, normalize.parse_params)

#: Parameters after the semicolon rule, decoded, for SQL twins.
PARAMS = f"""{BASE}, dec AS (SELECT *, replace(replace(token, '%C3', chr(195)), '%A9', chr(169)) AS d FROM tok),
sem AS (SELECT *, contains(d, ';') AND len(list_filter(string_split(d, ';'), lambda x: contains(x, '='))) >= 2 AS split FROM dec),
par AS (SELECT request_id, label, pos, i, x, split_part(x, '=', 1) AS key, CASE WHEN contains(x, '=') THEN replace(replace(substr(x, strpos(x, '=') + 1), '%20', ' '), '%00', chr(0)) END AS value
  FROM (SELECT request_id, label, pos, unnest(CASE WHEN split THEN string_split(d, ';') ELSE [d] END) AS x, generate_subscripts(CASE WHEN split THEN string_split(d, ';') ELSE [d] END, 1) AS i FROM sem)),
num AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos, i) - 1 AS n, count(value) OVER (PARTITION BY request_id, key) AS c FROM par)
"""


@query(f"""{PARAMS} SELECT request_id, n AS pos, key, value, concat_ws(' ', CASE WHEN value IS NOT NULL AND ends_with(key, '[]') THEN concat('QARRAY:', key) END, CASE WHEN value IS NULL THEN 'QBARE' END,
  CASE WHEN value = '' THEN 'QEMPTYVAL' END, CASE WHEN regexp_matches(value, '[^\\x00-\\x7F]') THEN 'QNONASCII' END, CASE WHEN contains(value, chr(0)) THEN 'QNUL' END, CASE WHEN value IS NOT NULL AND c > 1 THEN concat('QREPEAT:', key) END) AS qflags FROM num""")
def b17_b18_query_params(spark, sf_dir):
    df = good(spark, sf_dir, *QUERY_STEPS)
    own = F.filter("p.flags", lambda f: f.startswith("Q") & (f != "QUOTE"))
    return T.unnest(df, "params", "p", "request_id").select(
        "request_id", F.col("p.pos").cast("long").alias("pos"), "p.key", "p.value", joined(own).alias("qflags")
    )


#: Values made of an event: its number, type, text, digests in several forms, an address, a mail address, a link.
_VALUES = """(SELECT event_id AS request_id, unnest([CAST(value AS VARCHAR), event_type, props, md5(props), concat(left(md5(props), 8), '-', substr(md5(props), 9, 4), '-4', substr(md5(props), 14, 3), '-a', substr(md5(props), 18, 3), '-', right(md5(props), 12)),
  concat(user_id % 256, '.', event_id % 256, '.0.1'), concat(event_type, user_id, '@example.com'), concat('https://example.com/', event_type), concat(md5(props), '=='), concat('eyJ', md5(props), '.', event_type, '.', md5(event_type))]) AS v FROM events)"""


@query(f"""SELECT request_id, v, CASE {" ".join(f"WHEN regexp_matches(v, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in T.SHAPES)} ELSE 'mixed' END AS shape FROM {_VALUES}""")
def b19_value_shape(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.md5("props").alias("m"))
    m = F.col("m")
    cut = lambda a, n: F.substring(m, a, n)
    uuid_ = F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), F.right(m, F.lit(12)))
    cell = F.array(
        F.col("value").cast("string"), "event_type", "props", m, uuid_, F.concat(F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256, F.lit(".0.1")),
        F.concat("event_type", "user_id", F.lit("@example.com")), F.concat(F.lit("https://example.com/"), "event_type"), F.concat(m, F.lit("==")),
        F.concat(F.lit("eyJ"), m, F.lit("."), "event_type", F.lit("."), F.md5("event_type")),
    )
    return e.select(F.col("event_id").alias("request_id"), F.explode(cell).alias("v")).withColumn("shape", T.value_shape(F.col("v")))


@query(f"""{PARAMS} SELECT request_id, n AS pos, CASE WHEN value IS NULL THEN key WHEN key = 'token' OR key = 'k' AND false THEN concat(key, '=<SECRET:b64url:', strlen(value), '>') ELSE concat(key, '=', value) END AS display FROM num""")
def b20_redact_values(spark, sf_dir):
    df = good(spark, sf_dir, *QUERY_STEPS)
    return T.unnest(df, "params", "p", "request_id").select("request_id", F.col("p.pos").cast("long").alias("pos"), "p.display")


@query(f"{BASE} SELECT request_id, url_decode(query) AS q FROM good WHERE query IS NOT NULL")
def b21_url_unquote(spark, sf_dir):
    return good(spark, sf_dir).where("query IS NOT NULL").select("request_id", T.url_unquote(F.col("query")).alias("q"))


@query(f"""{PARAMS} SELECT g.request_id, count(n.key) AS count, CASE WHEN bool_or(contains(g.query, ';')) THEN 'QSEMISEP' ELSE '' END AS qsep FROM good g LEFT JOIN num n USING (request_id) GROUP BY g.request_id""")
def b22_query_meta(spark, sf_dir):
    return good(spark, sf_dir, *QUERY_STEPS).select("request_id", F.col("qmeta.count").cast("long").alias("count"), joined("qsep").alias("qsep"))


@query(f"""{BASE} SELECT request_id, CASE WHEN n = '/' OR n = '' THEN '/' ELSE n END AS path, concat_ws(' ', CASE WHEN NOT root AND list_contains(s, '.') THEN 'DOTCUR' END, CASE WHEN NOT root AND list_contains(s, '..') THEN 'DOTDOT' END,
  CASE WHEN n IN ('', '/') THEN 'HOME' END, CASE WHEN NOT root AND list_contains(s, '') THEN 'MULTIPLESLASH' END) AS flags
FROM (SELECT request_id, path IN ('', '/') AS root, string_split(path, '/') AS s, concat(CASE WHEN starts_with(path, '/') THEN '/' ELSE '' END, coalesce(list_aggregate(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), 'string_agg', '/'), '')) AS n FROM good)""")
def b23_normalize_path(spark, sf_dir):
    df = normalize.normalize_path(good(spark, sf_dir).withColumn("path_flags", T.no_flags()))
    return df.select("request_id", "path", joined("path_flags").alias("flags"))


@query(f"""{BASE} SELECT g.request_id, concat('[METHOD] ', method, CASE WHEN method = 'PROPFIND' THEN ' UNUSUAL_METHOD' ELSE '' END) AS first_line FROM good g""")
def b24_render_canonical(spark, sf_dir):
    return normalized(spark, sf_dir).select("request_id", F.substring_index("canonical", "\n", 1).alias("first_line"))


@query(f"""{BASE} SELECT g.request_id, count(t.token) + count(*) FILTER (contains(t.token, ';')) AS count, CASE WHEN bool_or(contains(g.query, ';')) THEN 'QSEMISEP' ELSE '' END AS qsep,
  concat_ws(' ', CASE WHEN bool_or(t.token LIKE 'arr[]%') THEN 'QARRAY:arr[]' END, CASE WHEN bool_or(NOT contains(t.token, '=')) THEN 'QBARE' END, CASE WHEN bool_or(t.token = 'e=') THEN 'QEMPTYVAL' END,
    CASE WHEN bool_or(contains(t.token, '%C3')) THEN 'QNONASCII' END, CASE WHEN bool_or(contains(t.token, '%00')) THEN 'QNUL' END) AS flags
FROM good g LEFT JOIN tok t USING (request_id) GROUP BY g.request_id""")
def b25_query_params_v2(spark, sf_dir):
    df = query_v2.query_params_v2(good(spark, sf_dir))
    return df.select("request_id", F.col("qmeta2.count").cast("long").alias("count"), joined("qsep2").alias("qsep"), joined("qmeta2.flags").alias("flags"))


@query(f"{BASE} SELECT request_id, lower(url_decode(url_decode(concat(path, '?', coalesce(query, ''))))) AS text FROM good")
def b26_paper_preprocess(spark, sf_dir):
    text = F.concat("path", F.lit("?"), F.coalesce("query", F.lit("")))
    return good(spark, sf_dir).select("request_id", T.paper_preprocess(text).alias("text"))


@query(f"{BASE} SELECT request_id, concat(split_part(request, chr(10), 1), ' body ', request_id) AS text FROM good")
def b27_strip_headers(spark, sf_dir):
    text = F.concat("request", F.lit("\n\n body "), F.col("request_id").cast("string"), F.lit(" \n"))
    return good(spark, sf_dir).select("request_id", T.strip_headers(text).alias("text"))


#: Flags of normalised requests as one long table, for SQL twins.
FLAGS = f"""{PARAMS},
flg AS (
  SELECT request_id, label, 'UNUSUAL_METHOD' AS flag FROM good WHERE method = 'PROPFIND'
  UNION ALL SELECT request_id, label, 'HDRNORM' FROM good
  UNION ALL SELECT request_id, label, 'BADHOST' FROM good WHERE NOT contains(request, 'Host: ')
  UNION ALL SELECT request_id, label, unnest(CASE path WHEN '/' THEN ['HOME'] WHEN '/./x' THEN ['DOTCUR', 'MULTIPLESLASH'] WHEN '/../etc/passwd' THEN ['DOTDOT', 'MULTIPLESLASH']
    WHEN '/p%2541' THEN ['DOUBLEPCT', 'MULTIPLESLASH'] WHEN '/d%2Fe' THEN ['MULTIPLESLASH', 'PCTSLASH'] WHEN '/<s>' THEN ['ANGLE', 'MULTIPLESLASH'] ELSE ['MULTIPLESLASH'] END) FROM good
  UNION ALL SELECT request_id, label, unnest(list_filter([
    CASE WHEN value IS NOT NULL AND ends_with(key, '[]') THEN concat('QARRAY:', key) END, CASE WHEN value IS NULL THEN 'QBARE' END, CASE WHEN value = '' THEN 'QEMPTYVAL' END,
    CASE WHEN regexp_matches(value, '[^\\x00-\\x7F]') THEN 'QNONASCII' END, CASE WHEN value IS NOT NULL AND c > 1 THEN concat('QREPEAT:', key) END,
    CASE WHEN contains(value, ' ') THEN 'PCTSPACE' END, CASE WHEN contains(value, ' ') THEN 'SPACE' END], lambda x: x IS NOT NULL)) FROM num
  UNION ALL SELECT request_id, label, unnest(['CONTROL', 'NUL', 'PCTNULL', 'QNUL']) FROM num WHERE contains(value, chr(0))
  UNION ALL SELECT n.request_id, n.label, 'SEMICOLON' FROM num n JOIN good g USING (request_id) WHERE contains(g.query, ';')
  UNION ALL SELECT request_id, label, 'QSEMISEP' FROM good WHERE contains(query, ';')
  UNION ALL SELECT request_id, label, unnest(list_filter([CASE WHEN many > 1 THEN 'DUPHDR' END, CASE WHEN many > 1 THEN 'HDRMERGE' END, CASE WHEN name = 'connection' THEN 'HOPBYHOP' END,
    CASE WHEN fold THEN 'OBSFOLD' END, CASE WHEN regexp_matches(value, '  |\\t') THEN 'WSPAD' END, CASE WHEN name = 'user-agent' THEN 'PAREN' END], lambda x: x IS NOT NULL)) FROM ent)
"""


def long_flags(spark, sf_dir):
    return normalize.extract_flags(normalized(spark, sf_dir))


@query(f"{FLAGS} SELECT request_id, flag, count(*) AS n FROM flg GROUP BY ALL")
def b28_extract_flags(spark, sf_dir):
    return long_flags(spark, sf_dir).groupBy("request_id", "flag").agg(F.count("*").alias("n"))


@query(f"""{BASE} SELECT g.request_id, CASE WHEN length(path) <= 15 THEN '0-15' ELSE '16-31' END AS plen, CASE WHEN h.c <= 15 THEN '0-15' ELSE '16-31' END AS hcnt,
  CASE WHEN h.b <= 15 THEN '0-15' WHEN h.b <= 31 THEN '16-31' WHEN h.b <= 63 THEN '32-63' ELSE '64-127' END AS hlen
FROM good g JOIN (SELECT request_id, count(*) AS c, sum(length(value)) AS b FROM ent GROUP BY 1) h USING (request_id)""")
def b29_length_buckets(spark, sf_dir):
    return normalize.length_buckets(normalized(spark, sf_dir)).select("request_id", "plen", "hcnt", "hlen")


_LF, _CR = "contains(replace(t, chr(13) || chr(10), ''), chr(10))", "contains(replace(t, chr(13) || chr(10), ''), chr(13))"


@query(f"""SELECT doc_id, k, concat_ws(' ', CASE WHEN {_CR} THEN 'EOL_BARECR' END, CASE WHEN {_LF} THEN 'EOL_BARELF' END, CASE WHEN NOT ends_with(t, chr(13) || chr(10)) THEN 'EOL_EOF_NOCRLF' END,
  CASE WHEN CAST({_LF} AS INT) + CAST({_CR} AS INT) + CAST(contains(t, chr(13) || chr(10)) AS INT) >= 2 THEN 'EOLMIX' END) AS flags
FROM (SELECT doc_id, unnest([1, 2, 3, 4]) AS k, unnest([text, replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(10), replace(text, '. ', '.' || chr(13)), replace(text, ', ', chr(13) || chr(10))]) AS t FROM documents)""")
def b30_eol_anomalies(spark, sf_dir):
    """Texts with their own line ends, with CRLF, and with CR or CRLF in place of some blanks."""
    t = F.col("text")
    cell = F.array(t, F.concat(F.replace(t, F.lit("\n"), F.lit("\r\n")), F.lit("\r\n")), F.replace(t, F.lit(". "), F.lit(".\r")), F.replace(t, F.lit(", "), F.lit("\r\n")))
    got = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cell).alias("k", "t"))
    return got.select("doc_id", (F.col("k") + 1).alias("k"), joined(T.eol_anomalies(F.col("t"))).alias("flags"))


@query(f"{FLAGS} SELECT g.request_id, count(f.flag) AS n_flags, count(DISTINCT f.flag) AS n_unique FROM good g LEFT JOIN flg f USING (request_id) GROUP BY 1")
def b31_normalize_requests(spark, sf_dir):
    df = normalized(spark, sf_dir)
    return df.select("request_id", F.size("all_flags").cast("long").alias("n_flags"), F.size(F.array_distinct("all_flags")).cast("long").alias("n_unique"))


@query(f"{FLAGS} SELECT request_id, flag, count(*) AS n FROM flg GROUP BY ALL")
def b28_flags_from_text(spark, sf_dir):
    """Flags read back from the canonical text alone."""
    got = normalize.flags_from_canonical(normalized(spark, sf_dir).select("request_id", "canonical"), keys=("request_id",))
    return got.groupBy("request_id", "flag").agg(F.count("*").alias("n"))


_FAMILY = "CASE " + " ".join(f"WHEN split_part(flag, ':', 1) IN ({', '.join(repr(n) for n in names)}) THEN '{fam}'" for fam, names in normalize.FAMILIES.items()) + " ELSE 'other' END"


@query(f"{FLAGS} SELECT request_id, {_FAMILY} AS family, count(*) AS n_flags FROM flg GROUP BY ALL")
def b32_flag_families(spark, sf_dir):
    return normalize.flag_families(long_flags(spark, sf_dir))
