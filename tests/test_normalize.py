import pytest
from pyspark.sql import functions as F

from requestlab.functions import text as T
from requestlab.operators import normalize as N
from requestlab.operators import query_v2


def rows(spark, *texts):
    df = spark.createDataFrame([(i, "valid", t) for i, t in enumerate(texts)], "request_id long, label string, request string")
    return {r["request_id"]: r for r in N.normalize_requests(df).collect()}


HOST = "\nHost: shop.example.com"


@pytest.fixture(scope="module")
def golden(spark):
    lines = [
        "GET / HTTP/1.1" + HOST,
        "GET /a//b HTTP/1.1" + HOST,
        "GET /./x HTTP/1.1" + HOST,
        "GET /../etc/passwd HTTP/1.1" + HOST,
        "GET /p%2541 HTTP/1.1" + HOST,
        "GET /d%2Fe HTTP/1.1" + HOST,
        "PROPFIND /<s>?q=a%20b&bare HTTP/1.1\nAccept: a\naccept: b\nConnection:    close\nX-Fold: a\n  b",
        "GET /x?x=1&x=2&e=&arr[]=1&token=8&n=%C3%A9&z=%00 HTTP/1.1" + HOST,
        "GET /x?a=1;b=2 HTTP/1.1" + HOST,
        "GET /x",
        "GET http://other.org/x HTTP/1.1" + HOST,
        "GET /Ａ HTTP/1.1\nHost: bücher.example",
        "",
        None,
    ]
    return rows(spark, *lines)


@pytest.mark.parametrize(
    "i, path, flags",
    [
        (0, "/", {"HOME"}),
        (1, "/a/b", {"MULTIPLESLASH"}),
        (2, "/x", {"DOTCUR", "MULTIPLESLASH"}),
        (3, "/../etc/passwd", {"DOTDOT", "MULTIPLESLASH"}),
        (4, "/p%41", {"DOUBLEPCT", "MULTIPLESLASH"}),
        (5, "/d%2Fe", {"PCTSLASH", "MULTIPLESLASH"}),
        (6, "/<s>", {"ANGLE", "MULTIPLESLASH"}),
        (11, "/A", {"FULLWIDTH", "MULTIPLESLASH"}),
    ],
)
def test_paths(golden, i, path, flags):
    assert golden[i]["path"] == path
    assert set(golden[i]["path_flags"]) == flags


def test_headers(golden):
    r = golden[6]
    got = {h["name"]: (h["value"], set(h["flags"])) for h in r["headers"]}
    assert got["accept"] == ("a, b", {"DUPHDR", "HDRMERGE", "WSPAD"})
    assert got["connection"] == ("close", {"HOPBYHOP", "WSPAD"})
    assert got["x-fold"] == ("a b", {"OBSFOLD"})
    assert set(r["flags"]) == {"UNUSUAL_METHOD", "HDRNORM", "BADHOST"}
    assert r["url_abs"] is None
    assert golden[0]["url_abs"] == "http://shop.example.com/"


def test_query(golden):
    q = {p["display"]: set(p["flags"]) for p in golden[7]["params"]}
    assert q["x=1"] == {"QREPEAT:x"} and q["e="] == {"QEMPTYVAL"} and q["arr[]=1"] == {"QARRAY:arr[]"}
    assert q["token=<SECRET:b64url:1>"] == set()
    assert q["n=Ã©"] == {"QNONASCII"}
    assert q["z=\x00"] == {"CONTROL", "NUL", "PCTNULL", "QNUL"}
    assert {p["display"]: set(p["flags"]) for p in golden[6]["params"]} == {"q=a b": {"PCTSPACE", "SPACE"}, "bare": {"QBARE"}}
    assert golden[8]["qsep"] == ["QSEMISEP"] and golden[8]["qmeta"]["count"] == 2


def test_rejects_and_hosts(golden):
    assert golden[9]["error"] == "expected 3 parts, got 2"
    assert golden[12]["error"] == golden[13]["error"] == "empty request"
    assert "HOSTMISMATCH" in golden[10]["flags"]
    assert golden[11]["url_abs"].startswith("http://xn--bcher-kva.example/") and "IDNA" in golden[11]["flags"]


def test_steps_compose(spark):
    df = spark.createDataFrame([(1, "valid", "GET /x HTTP/1.1")], "request_id long, label string, request string")
    assert N.apply_steps(df, ()).columns == df.columns
    assert N.normalize_requests(df.where("false")).count() == 0


def test_path_and_ws_idempotent(spark):
    df = spark.createDataFrame([("/a//./b/",), ("/",), ("x/../y",)], "path string").withColumn("path_flags", T.no_flags())
    once = N.normalize_path(df)
    assert [r["path"] for r in N.normalize_path(once).collect()] == [r["path"] for r in once.collect()]
    assert "MULTIPLESLASH" not in N.normalize_path(spark.createDataFrame([("/a/b",)], "path string").withColumn("path_flags", T.no_flags()), compat=False).first()["path_flags"]


def test_query_v2_golden(spark):
    q = "q=foo.bar&user=John+Doe&flag&empty=&list=1&list=2&encoded=%2Fpath%2F..%2F&space=hello%20world&plus=a+b&semi=1;2;3&weird==&lonely&multi=%CE%B1%CE%B2%CE%B3&multi=x%C3%A9"
    r = query_v2.render_v2(query_v2.query_params_v2(spark.createDataFrame([(q,)], "query string"))).first()
    lines = r["lines2"]
    assert lines[:4] == ["[QPARAM] q=foo.bar", "[QPARAM] user=John+Doe", "[QPARAM] flag QBARE", "[QPARAM] empty= QEMPTYVAL"]
    assert lines[6] == "[QPARAM] encoded=/path/../" and lines[10] == "[QPARAM] weird=="
    assert lines[-2:] == ["[QSEP] QRAWSEMI", "[QMETA] count=14 QBARE QEMPTYVAL QNONASCII"]


@pytest.mark.parametrize("given, want", [("a%20b", "a b"), ("a+b", "a+b"), ("%", "%"), ("%zz", "%zz"), ("%e2%82%ac", "€"), ("x", "x")])
def test_unquote(spark, given, want):
    assert spark.range(1).select(T.url_unquote(F.lit(given))).first()[0] == want
