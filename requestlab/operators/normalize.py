"""Request normalisation: raw text to one typed row of parts and flags.

Every step is DataFrame -> DataFrame and adds or replaces columns; no step shuffles.  Lists
inside a request (header lines, query parameters) are handled by higher-order functions, so a
request stays one row from scan to sink.  Only NFKC and IDNA leave the JVM, and only rows with
non-ASCII text reach them.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from requestlab.functions import text as T

# Fixed values
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD", "TRACE", "CONNECT")
MERGEABLE = ("accept", "accept-encoding", "accept-language", "cache-control", "pragma", "link", "www-authenticate")
HOP_BY_HOP = ("connection", "te", "upgrade", "trailer")
LONG_VALUE = 1024
_BAD_NAME = r"[^!#$%&'*+\-.^_`|~0-9A-Za-z]"

Step = Callable[[DataFrame], DataFrame]


def trim(df: DataFrame) -> DataFrame:
    """``request`` without framing noise, ``framing_flags`` telling what went."""
    return df.withColumns({"framing_flags": T.framing_flags(F.col("request")), "request": T.trim_framing(F.col("request"))})


def parse_request_line(df: DataFrame) -> DataFrame:
    """B2: ``method, path, query, flags, error``; malformed rows have an error and null parts."""
    line = F.element_at(F.split("request", "\n", -1), 1)
    parts = F.split(line, " ", -1)
    blank = F.col("request").isNull() | ~F.col("request").rlike(r"\S")
    error = (
        F.when(blank, "empty request")
        .when(F.size(parts) != 3, F.concat(F.lit("expected 3 parts, got "), F.size(parts).cast("string")))
        .when(~F.element_at(parts, 3).startswith("HTTP/"), "not an HTTP version")
    )
    df = df.withColumns({"_p": parts, "error": error})
    ok = F.col("error").isNull()
    target = F.col("_p")[1]
    cut = F.instr(target, "?")
    df = df.withColumns(
        {
            "method": F.when(ok, F.col("_p")[0]),
            "path": F.when(ok, F.substring_index(target, "?", 1)),
            "query": F.when(ok & (cut > 0), F.expr("substring(_p[1], instr(_p[1], '?') + 1)")),
        }
    )
    df = df.withColumn("flags", T.flag_list((ok & ~F.col("method").isin(*METHODS), "UNUSUAL_METHOD"))).drop("_p")
    return T.settle(df, "request", "error", "method", "path", "query", "flags")


def reject(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and the reject table ``request_id, error, request``."""
    keep = [c for c in ("request_id", "error", "request") if c in df.columns]
    return df.where("error IS NULL").drop("error"), df.where("error IS NOT NULL").select(*keep)


def split_query(df: DataFrame) -> DataFrame:
    """``tokens`` of the query."""
    return df.withColumn("tokens", T.split_query_entities(F.col("query")))


def header_lines(df: DataFrame) -> DataFrame:
    """``header_lines`` after the request line up to the first line that is empty but for a CR."""
    lines = F.slice(F.split("request", "\n", -1), F.lit(2), F.size(F.split("request", "\n", -1)))
    stop = F.array_position(F.transform(lines, lambda x: F.regexp_replace(x, "\r$", "")), "")
    return df.withColumns({"_l": lines, "_s": stop.cast("int")}).withColumn(
        "header_lines", F.when(F.col("_s") > 0, F.slice("_l", F.lit(1), F.col("_s") - 1)).otherwise(F.col("_l"))
    ).drop("_l", "_s")


def unfold_headers(df: DataFrame) -> DataFrame:
    """``unfolded`` (text, flags) with continuation lines joined by one space; BADHDRCONT on the request."""
    kind = "struct<h:array<struct<text:string,flags:array<string>>>,orphan:boolean>"
    zero = F.struct(F.array().alias("h"), F.lit(False).alias("orphan")).cast(kind)

    def folded(x: Column) -> Column:
        return x.startswith(" ") | x.startswith("\t")

    def item(text: Column, flags: Column) -> Column:
        return F.array(F.struct(text.alias("text"), flags.alias("flags")))

    def alone(x: Column) -> Column:
        odd = F.when(x.contains("\r") | ~x.contains(":"), F.array(F.lit("BADCRLF"))).otherwise(T.no_flags())
        return F.struct(x.alias("text"), odd.alias("flags"))

    def add(acc: Column, x: Column) -> Column:
        cr = x.contains("\r")
        more = folded(x)
        last = F.element_at(acc["h"], -1)
        joined = item(
            F.concat(last["text"], F.lit(" "), F.regexp_replace(x, "^[ \t]+", "")),
            F.array_union(last["flags"], T.flag_list((cr, "BADCRLF"), (F.lit(True), "OBSFOLD"))),
        )
        own = item(x, T.flag_list((cr | ~x.contains(":"), "BADCRLF")))
        none = F.size(acc["h"]) == 0
        h = (
            F.when(more & none, acc["h"])
            .when(more, F.concat(F.slice(acc["h"], F.lit(1), F.greatest(F.size(acc["h"]) - 1, F.lit(0))), joined))
            .otherwise(F.concat(acc["h"], own))
        )
        return F.struct(h.alias("h"), (acc["orphan"] | (more & none)).alias("orphan")).cast(kind)

    lines = F.coalesce("header_lines", T.no_flags())
    plain = F.struct(F.transform(lines, alone).alias("h"), F.lit(False).alias("orphan")).cast(kind)  # no line continues another
    df = df.withColumn("_u", F.when(F.exists(lines, folded), F.aggregate(lines, zero, add)).otherwise(plain))
    df = df.withColumns(
        {
            "unfolded": F.col("_u.h"),
            "flags": T.union_all(
                F.col("flags"),
                T.flag_list(
                    (F.col("_u.orphan"), "BADHDRCONT"),
                    (F.exists(F.col("_u.h"), lambda x: ~x["text"].contains(":")), "BADCRLF"),
                ),
            ),
        }
    )
    return df.drop("_u")


def normalize_headers(df: DataFrame) -> DataFrame:
    """``headers`` (name, value, flags) in canonical order, ``hagg``, HDRNORM on the request.

    Values keep their text after the colon until :func:`collapse_header_ws`; lengths in
    ``hagg`` count it.
    """

    def cut(x: Column) -> Column:
        at = F.instr(x["text"], ":")
        name = F.substring_index(x["text"], ":", 1)
        blank = functools.reduce(operator.or_, [name.contains(c) for c in " \t\n\x0b\f\r"])
        return F.struct(
            F.when(at == 0, F.lit("")).when(blank, F.regexp_replace(name, r"^\s+|\s+$", "")).otherwise(name).alias("given"),
            F.when(at == 0, F.lit("")).otherwise(F.substr(x["text"], at + 1)).alias("value"),
            x["flags"].alias("flags"),
        )

    raw = F.filter(F.transform("unfolded", cut), lambda x: x["given"] != "")
    named = F.transform(raw, lambda x: F.struct(F.lower(x["given"]).alias("name"), x["given"], x["value"], x["flags"]))
    df = df.withColumn("_h", named)
    df = df.withColumn("_n", F.array_distinct(F.transform("_h", lambda x: x["name"])))
    single = F.size("_n") == F.size("_h")  # no name stands twice

    def own(n: Column, *more: tuple[Column, str]) -> Column:
        return T.flag_list((n.isin(*HOP_BY_HOP), "HOPBYHOP"), (n.rlike(_BAD_NAME), "BADHDRNAME"), *more)

    def entry(n: Column, value: Column, flags: Column) -> Column:
        return F.struct(n.alias("name"), value.alias("value"), flags.alias("flags"))

    def entries(n: Column) -> Column:
        def of(mine: Column) -> Column:
            many = F.size(mine) > 1
            merge = many & n.isin(*MERGEABLE)
            base = own(n, (many, "DUPHDR"), (merge, "HDRMERGE"))
            text = F.array_join(F.transform(mine, lambda x: x["value"]), ", ")
            merged = F.array(entry(n, text, T.union_all(base, F.flatten(F.transform(mine, lambda x: x["flags"])))))
            return F.when(merge, merged).otherwise(F.transform(mine, lambda x: entry(n, x["value"], T.union_all(base, x["flags"]))))

        return T.let(F.filter("_h", lambda x: x["name"] == n), of)

    each = F.transform("_h", lambda x: entry(x["name"], x["value"], T.union_all(own(x["name"]), x["flags"])))
    df = df.withColumn("_e", F.when(single, each).otherwise(F.flatten(F.transform("_n", entries))))
    plain = F.sort_array(F.filter("_e", lambda x: x["name"] != "set-cookie"))
    cookies = F.filter("_e", lambda x: x["name"] == "set-cookie")
    sizes = F.when(F.size("_n") == F.size("_e"), F.transform("_e", lambda x: F.length(x["value"]))).otherwise(
        F.transform("_n", lambda n: F.length(F.array_join(F.transform(F.filter("_e", lambda x: x["name"] == n), lambda x: x["value"]), ",")))
    )
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    repeated = F.size(F.filter("_n", lambda n: F.size(F.filter("_h", lambda x: x["name"] == n)) > 1))
    hagg = F.struct(
        F.size("_e").alias("h_count"),
        F.when(single, 0).otherwise(repeated).alias("dup_names"),
        F.exists("_n", lambda n: n.isin(*HOP_BY_HOP)).cast("int").alias("hopbyhop"),
        F.size(F.filter("_h", lambda x: x["name"].rlike(_BAD_NAME))).alias("bad_names"),
        total.alias("total_bytes"),
    )
    changed = F.exists("_h", lambda x: x["name"] != x["given"])
    df = df.withColumns(
        {"headers": F.concat(plain, cookies), "hagg": hagg, "flags": T.union_all(F.col("flags"), T.flag_list((changed, "HDRNORM")))}
    )
    return df.drop("_h", "_n", "_e")


def _with_header_flags(df: DataFrame, value: Callable[[Column], Column], flags: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(
        "headers",
        F.transform(
            "headers",
            lambda h: F.struct(
                h["name"].alias("name"), value(h).alias("value"), T.union_all(h["flags"], flags(h)).alias("flags")
            ),
        ),
    )


def collapse_header_ws(df: DataFrame) -> DataFrame:
    """Runs of blanks in values become one space, ends trimmed; WSPAD where padding was beyond normal."""

    def secret(h: Column) -> Column:
        shown = F.trim(h["value"])
        return shown.startswith("<SECRET:") & shown.rlike(r"(?s)^<SECRET:.*>$")

    def padded(h: Column) -> Column:
        return h["value"].contains("  ") | h["value"].contains("\t")

    def tidy(h: Column) -> Column:
        blanks = F.when(padded(h), F.regexp_replace(h["value"], "[ \t]+", " ")).otherwise(h["value"])
        return F.when(secret(h), h["value"]).otherwise(F.trim(blanks))

    return _with_header_flags(df, tidy, lambda h: T.flag_list((padded(h) & ~secret(h), "WSPAD")))


def flag_dangerous(df: DataFrame) -> DataFrame:
    """Character and script flags of path, query tokens and headers.

    Turns ``tokens`` into ``params`` (text, flags) and adds ``path_flags``.
    """
    path = T.first_token(F.col("path"))
    df = df.withColumn(
        "path_flags", T.union_all(T.dangerous_flags(path), T.flag_list((T.mixed_script(path), "MIXEDSCRIPT")))
    )

    def param(x: Column) -> Column:
        with_nul = lambda found: F.when(F.array_contains(found, "NUL"), F.concat(found, F.array(F.lit("QNUL")))).otherwise(found)
        found = T.let(T.let(T.first_token(x), T.dangerous_flags), with_nul)
        return F.struct(x.alias("text"), T.sorted_set(found).alias("flags"))

    df = df.withColumn("params", F.transform("tokens", param))

    def of_header(h: Column) -> Column:
        both = lambda c: F.concat(T.dangerous_flags(c, skip=("SEMICOLON", "SPACE")), T.flag_list((T.mixed_script(c), "MIXEDSCRIPT")))
        return T.let(F.concat(h["name"], F.lit(": "), h["value"]), both)

    return _with_header_flags(df, lambda h: h["value"], of_header)


# IPv6 without embedded IPv4: eight groups, or fewer around one "::".
_V6 = "|".join(
    [r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"]
    + [rf"(?:[0-9a-fA-F]{{1,4}}:){{1,{7 - k}}}(?::[0-9a-fA-F]{{1,4}}){{1,{k}}}" for k in range(1, 7)]
    + [r"(?:[0-9a-fA-F]{1,4}:){1,7}:", r":(?::[0-9a-fA-F]{1,4}){1,7}", r"::"]
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"[a-zA-Z0-9\x{0080}-\x{FFFF}](?:[a-zA-Z0-9\x{0080}-\x{FFFF}\-]*[a-zA-Z0-9\x{0080}-\x{FFFF}])?"


def host_is_valid(host: Column) -> Column:
    """Bracketed IPv6, dotted IPv4 where there are three dots, else a name of at least two labels."""
    name = (
        host.contains(".")
        & ~host.contains("..")
        & ~host.rlike(r"^-|-\z")
        & (F.octet_length(host) <= 253)
        & host.rlike(rf"^{_LABEL}(?:\.{_LABEL})*\z")
    )
    v6 = host.rlike(rf"^\[(?:{_V6})\]\z")
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return (
        F.when(host.isNull() | (F.trim(host) == ""), False)
        .when(host.startswith("["), v6)
        .when(dots == 3, host.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"))
        .otherwise(name)
    )


def split_host(df: DataFrame) -> DataFrame:
    """``host`` (null if missing or invalid) and ``port`` from the host header, the last one if repeated."""
    given = T.first_token(F.try_element_at(F.filter("headers", lambda h: h["name"] == "host"), F.lit(-1))["value"])
    df = df.withColumn("_g", F.nullif(given, F.lit("")))
    g = F.col("_g")
    v6 = g.rlike(r"^\[[0-9a-fA-F:]+\](?::[0-9]+)?\z")
    host = F.when(v6, F.regexp_extract(g, r"^(\[[^\]]*\])", 1)).when(g.contains(":"), F.regexp_extract(g, r"(?s)^(.*):[^:]*\z", 1)).otherwise(g)
    digits = F.when(g.contains(":") & ~g.rlike(r"\]\z"), F.regexp_extract(g, r":([^:]*)\z", 1))
    port = F.when(digits.rlike(r"^[0-9]{1,9}\z"), digits.cast("int"))
    bad = digits.isNotNull() & (port.isNull() | (~v6 & ~port.between(1, 65535)))
    df = df.withColumns({"host": F.when(~bad & (host != ""), host), "port": F.when(~bad, port)})
    return df.withColumn("host", F.when(host_is_valid(F.col("host")), F.col("host"))).drop("_g")


@F.pandas_udf(StringType())
def _idna(values: pd.Series) -> pd.Series:
    import idna  # without the package the job fails: results must not depend on what a machine has installed

    def one(v: str | None) -> str | None:
        try:
            return idna.encode(v).decode("ascii")
        except Exception:  # noqa: BLE001 - not an IDNA name: stays as it is
            return None

    return values.map(one)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(lambda vs: None if vs is None else [unicodedata.normalize("NFKC", v) for v in vs])


_NON_ASCII = r"[^\x00-\x7F]"


def absolute_url(df: DataFrame, wide: bool = True) -> DataFrame:
    """``url_abs`` and the flags BADHOST, IDNA, HOSTMISMATCH on the request.

    ``wide`` says that rows may hold non-ASCII text; without it no row goes to Python.
    """
    df = split_host(df)
    path = F.col("path")
    form = (
        F.when(path == "*", "asterisk")
        .when(path.contains("://"), "absolute")
        .when(path.contains(":") & ~path.contains("/"), "authority")
        .otherwise("origin")
    )
    url_host = F.lower(F.regexp_extract(path, r"^[^:]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    df = df.withColumns({"form": form, "_u": F.when(form == "absolute", url_host)})
    df = df.withColumns({"_hi": F.col("host"), "_ui": F.when(F.col("form") == "authority", path).otherwise(F.col("_u"))})
    if wide:
        df = df.withColumns({"_hi": _idna("_hi"), "_ui": _idna("_ui")})
    df = df.withColumns({"_hc": F.coalesce("_hi", "host"), "_uc": F.coalesce("_ui", "_u", "path")})
    form, host, port = F.col("form"), F.col("_hc"), F.col("port")
    suffix = F.when(port.isNotNull() & (port != 80), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    base = F.concat(F.lit("http://"), host, suffix)
    connect = F.upper("method") == "CONNECT"
    url = (
        F.when(form == "absolute", path)
        .when((form == "authority") & connect, F.col("_uc"))
        .when((form == "asterisk") & host.isNotNull(), F.concat(base, F.lit("/*")))
        .when((form == "origin") & host.isNotNull(), F.concat(base, path))
    )
    bare = lambda c: F.regexp_replace(F.lower(c), r"^\[|\]$", "")
    flags = T.flag_list(
        (path.isNotNull() & (form.isin("origin", "asterisk") & host.isNull() | (form == "authority") & ~connect), "BADHOST"),
        ((form == "absolute") & host.isNotNull() & (F.col("_u") != "") & (bare(F.col("_uc")) != bare(host)), "HOSTMISMATCH"),
        (
            form.isin("origin", "asterisk") & F.col("host").rlike(_NON_ASCII) & F.col("_hi").isNotNull()
            | (form == "absolute") & host.isNotNull() & F.col("_u").rlike(_NON_ASCII) & F.col("_ui").isNotNull()
            | (form == "authority") & connect & path.rlike(_NON_ASCII) & F.col("_ui").isNotNull(),
            "IDNA",
        ),
    )
    return df.withColumns({"url_abs": url, "flags": T.union_all(F.col("flags"), flags)}).drop("_u", "_hi", "_ui", "_hc", "_uc")


def nfkc_parts(df: DataFrame, wide: bool = True) -> DataFrame:
    """NFKC of path and query parameters, with the flags of what it met (``wide`` as above)."""
    texts = F.transform("params", lambda p: p["text"])
    df = df.withColumns({"_p": F.col("path"), "_t": texts})
    if wide:
        df = df.withColumns({"_p": _nfkc("_p"), "_t": _nfkc_each("_t")})
    params = F.zip_with(
        "params",
        "_t",
        lambda p, t: F.struct(t.alias("text"), T.union_all(p["flags"], T.unicode_flags(p["text"], t)).alias("flags")),
    )
    df = df.withColumns(
        {"path_flags": T.union_all(F.col("path_flags"), T.unicode_flags(F.col("path"), F.col("_p"))), "params": params, "path": F.col("_p")}
    )
    return df.drop("_p", "_t")


def percent_decode(df: DataFrame) -> DataFrame:
    """One decoding of path and parameters, with the flags of what stays encoded."""
    df = df.withColumns(
        {
            "path": T.percent_decode_once(F.col("path"), "URL"),
            "params": F.transform("params", lambda p: F.struct(T.percent_decode_once(p["text"], "QUERY").alias("text"), p["flags"].alias("flags"))),
        }
    )
    return df.withColumns(
        {
            "path_flags": T.union_all(F.col("path_flags"), T.percent_flags(F.col("path"), "URL")),
            "params": F.transform(
                "params", lambda p: F.struct(
                    p["text"].alias("text"),
                    F.when(p["text"].contains("%"), T.union_all(p["flags"], T.percent_flags(p["text"], "QUERY"))).otherwise(p["flags"]).alias("flags"),
                ),
            ),
        }
    )


def html_entities(df: DataFrame) -> DataFrame:
    """HTMLENT on path and parameters."""

    def entity(c: Column) -> Column:
        return F.when(c.contains("&"), T.flag_list((T.let(T.first_token(c), T.has_html_entity), "HTMLENT"))).otherwise(T.no_flags())

    return df.withColumns(
        {
            "path_flags": T.union_all(F.col("path_flags"), entity(F.col("path"))),
            "params": F.transform(
                "params",
                lambda p: F.struct(
                    p["text"].alias("text"),
                    F.when(p["text"].contains("&"), T.union_all(p["flags"], entity(p["text"]))).otherwise(p["flags"]).alias("flags"),
                ),
            ),
        }
    )


def parse_params(df: DataFrame) -> DataFrame:
    """Parameters with key, value, what is shown, and flags; ``qsep``, ``qmeta``.

    A parameter with at most one ampersand and at least two ``k=v`` pieces between semicolons
    is split there.
    """

    def pieces(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p["text"], ";", -1), lambda x: F.trim(x)), lambda x: x != "")
        pairs = F.size(F.filter(F.split(p["text"], ";", -1), lambda x: x.contains("=")))
        amps = F.length(p["text"]) - F.length(F.replace(p["text"], F.lit("&"), F.lit("")))
        out = lambda t: F.struct(t.alias("text"), p["flags"].alias("flags"))
        pack = lambda items, sep: F.struct(items.alias("items"), sep.alias("sep"))
        whole = F.array(out(p["text"]))
        return (
            F.when(~p["text"].contains(";"), pack(whole, T.no_flags()))
            .when((amps <= 1) & (pairs >= 2), pack(F.transform(parts, out), F.array(F.lit("QSEMISEP"))))
            .otherwise(pack(whole, F.array(F.lit("QRAWSEMI"))))
        )

    df = df.withColumn("_s", F.transform("params", pieces))
    df = df.withColumns(
        {"qsep": T.sorted_set(F.flatten(F.transform("_s", lambda x: x["sep"]))), "_i": F.flatten(F.transform("_s", lambda x: x["items"]))}
    )

    def split_pair(x: Column) -> Column:
        at = F.instr(x["text"], "=")
        value = F.when(at > 0, F.substr(x["text"], at + 1))
        return F.struct(F.substring_index(x["text"], "=", 1).alias("key"), value.alias("raw"), x["flags"].alias("flags"))

    def unquote(x: Column) -> Column:
        return F.struct(x["key"], x["raw"], T.url_unquote(x["raw"]).alias("value"), x["flags"])

    df = df.withColumn("_i", F.transform(F.transform("_i", split_pair), unquote))
    df = df.withColumn("_k", F.transform(F.filter("_i", lambda x: x["raw"].isNotNull()), lambda x: x["key"]))

    def finish(x: Column, pos: Column) -> Column:
        pair = x["raw"].isNotNull()
        flags = T.flag_list(
            (~pair, "QBARE"),
            (pair & (x["raw"] == ""), "QEMPTYVAL"),
            (pair & x["value"].contains("\x00"), "QNUL"),
            (pair & (x["key"].rlike(_NON_ASCII) | x["value"].rlike(_NON_ASCII)), "QNONASCII"),
            (pair & x["key"].endswith("[]"), F.concat(F.lit("QARRAY:"), x["key"])),
            (pair & (F.octet_length(x["value"]) > LONG_VALUE), "QLONG"),
            (pair & (F.size(F.filter("_k", lambda k: k == x["key"])) > 1), F.concat(F.lit("QREPEAT:"), x["key"])),
        )
        shown = F.when(pair, F.concat(x["key"], F.lit("="), T.redact_value(x["key"], x["value"]))).otherwise(x["key"])
        return F.struct(
            pos.alias("pos"), x["key"].alias("key"), x["value"].alias("value"), shown.alias("display"), T.union_all(x["flags"], flags).alias("flags")
        )

    df = df.withColumn("params", F.transform("_i", finish))
    union = T.sorted_set(F.flatten(F.transform("params", lambda p: p["flags"])))
    return df.withColumn("qmeta", F.struct(F.size("params").alias("count"), union.alias("flags"))).drop("_s", "_i", "_k")


def normalize_path(df: DataFrame, compat: bool = True) -> DataFrame:
    """Empty and ``.`` segments dropped, ``..`` kept; HOME, MULTIPLESLASH, DOTCUR, DOTDOT.

    ``compat`` counts the empty segment before a leading slash, so every absolute path but the
    root has MULTIPLESLASH; without it only real runs of slashes do.
    """
    path = F.col("path")
    parts = F.split(path, "/", -1)
    kept = F.filter(parts, lambda x: (x != "") & (x != "."))
    joined = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    root = path.isin("", "/")
    result = F.when(path.isNull(), F.lit(None).cast("string")).when(root | joined.isin("", "/"), "/").otherwise(joined)
    seen = parts if compat else F.when(path.startswith("/"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    flags = T.flag_list(
        (~root & F.array_contains(parts, "."), "DOTCUR"),
        (~root & F.array_contains(parts, ".."), "DOTDOT"),
        (result == "/", "HOME"),
        (~root & F.array_contains(seen, ""), "MULTIPLESLASH"),
    )
    return df.withColumns({"path": result, "path_flags": T.union_all(F.col("path_flags"), flags)})


def render_canonical(df: DataFrame) -> DataFrame:
    """``canonical`` tagged text of the typed row, in a fixed order."""

    def line(tag: str, body: Column, flags: Column) -> Column:
        return F.when(body.isNotNull(), F.concat_ws(" ", F.lit(tag), body, F.when(F.size(flags) > 0, F.array_join(flags, " "))))

    params = F.array_join(F.transform("params", lambda p: line("[QUERY]", p["display"], p["flags"])), "\n")
    headers = F.array_join(
        F.transform("headers", lambda h: line("[HEADER]", F.concat(h["name"], F.lit(": "), h["value"]), h["flags"])), "\n"
    )
    hagg = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(f"hagg.{k}").cast("string")) for k in ("h_count", "dup_names", "hopbyhop", "bad_names", "total_bytes")])
    some = lambda c: F.nullif(c, F.lit(""))
    text = F.concat_ws(
        "\n",
        line("[METHOD]", F.col("method"), F.array_intersect("flags", F.array(F.lit("UNUSUAL_METHOD")))),
        line("[URL]", F.col("path"), F.col("path_flags")),
        line("[URL_ABS]", F.col("url_abs"), T.no_flags()),
        some(params),
        line("[QSEP]", some(F.array_join("qsep", " ")), T.no_flags()),
        line("[QMETA]", F.concat(F.lit("count="), F.col("qmeta.count").cast("string")), F.col("qmeta.flags")),
        some(headers),
        line("[HAGG]", hagg, T.no_flags()),
        line("[FLAGS]", some(F.array_join(F.array_except("flags", F.array(F.lit("UNUSUAL_METHOD"))), " ")), T.no_flags()),
    )
    return df.withColumn("canonical", text)


def all_flags(df: DataFrame) -> DataFrame:
    """``all_flags``: every flag of the request with repetition, request first, then path, parameters, separators, headers."""
    return df.withColumn(
        "all_flags",
        F.concat(
            F.col("flags"),
            F.col("path_flags"),
            F.flatten(F.transform("params", lambda p: p["flags"])),
            F.col("qsep"),
            F.flatten(F.transform("headers", lambda h: h["flags"])),
        ),
    )


#: The configured order of steps.
STEPS: tuple[Step, ...] = (
    trim,
    parse_request_line,
    split_query,
    header_lines,
    unfold_headers,
    normalize_headers,
    collapse_header_ws,
    flag_dangerous,
    absolute_url,
    nfkc_parts,
    percent_decode,
    html_entities,
    parse_params,
    normalize_path,
    render_canonical,
    all_flags,
)


def apply_steps(df: DataFrame, steps: tuple[Step, ...]) -> DataFrame:
    """Steps in order; with none the input comes back."""
    for step in steps:
        df = df.transform(step)
    return df


def normalize_requests(df: DataFrame, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """The whole job over ``request`` (other columns pass).  Malformed rows keep their error and null parts.

    A Python UDF under CASE runs for every row, so rows with non-ASCII text are filtered into a
    branch of their own for the steps that need Python; the branch for all others has none.
    """
    at = [i for i, s in enumerate(steps) if s in (absolute_url, nfkc_parts)]
    if not at:
        return apply_steps(df, steps)
    first, last = at[0], at[-1] + 1
    df = apply_steps(df, steps[:first])
    other = F.coalesce(F.col("request").rlike(_NON_ASCII), F.lit(False))

    def narrow(step: Step) -> Step:
        return (lambda d: step(d, wide=False)) if step in (absolute_url, nfkc_parts) else step

    ascii_ = apply_steps(df.where(~other), tuple(narrow(s) for s in steps[first:last]))
    both = ascii_.unionByName(apply_steps(df.where(other), steps[first:last]))
    return apply_steps(both, steps[last:])


def extract_flags(df: DataFrame, keys: tuple[str, ...] = ("request_id", "label")) -> DataFrame:
    """Long table of flags of normalised requests: keys, part, pos, flag."""
    req = F.transform("flags", lambda f: F.struct(F.lit("request").alias("part"), F.lit(0).alias("pos"), f.alias("flag")))
    path = F.transform("path_flags", lambda f: F.struct(F.lit("path").alias("part"), F.lit(0).alias("pos"), f.alias("flag")))
    sep = F.transform("qsep", lambda f: F.struct(F.lit("qsep").alias("part"), F.lit(0).alias("pos"), f.alias("flag")))
    par = F.flatten(F.transform("params", lambda p: F.transform(p["flags"], lambda f: F.struct(F.lit("query").alias("part"), p["pos"].cast("int").alias("pos"), f.alias("flag")))))
    hdr = F.flatten(F.transform("headers", lambda h, i: F.transform(h["flags"], lambda f: F.struct(F.lit("header").alias("part"), i.cast("int").alias("pos"), f.alias("flag")))))
    return T.unnest(df, F.concat(req, path, par, sep, hdr), "_f", *keys).select(*keys, "_f.part", "_f.pos", "_f.flag")


# Flag families (our grouping of the flag names).
FAMILIES = {
    "danger": ("ANGLE", "QUOTE", "SEMICOLON", "PAREN", "BRACE", "PIPE", "BACKSLASH", "SPACE", "NUL", "MIXEDSCRIPT"),
    "encoding": ("DOUBLEPCT", "PCTSLASH", "PCTBACKSLASH", "PCTSPACE", "PCTCONTROL", "PCTNULL", "PCTSUSPICIOUS", "HTMLENT"),
    "unicode": ("FULLWIDTH", "CONTROL", "UNICODE_FORMAT", "MATH_UNICODE", "INVALID_UNICODE"),
    "query": ("QSEMISEP", "QRAWSEMI", "QBARE", "QEMPTYVAL", "QNUL", "QNONASCII", "QLONG", "QARRAY", "QREPEAT"),
    "header": ("BADHDRCONT", "OBSFOLD", "BADCRLF", "BADHDRNAME", "DUPHDR", "HOPBYHOP", "HDRMERGE", "HDRNORM", "WSPAD"),
    "host": ("HOSTMISMATCH", "IDNA", "BADHOST"),
    "path": ("HOME", "MULTIPLESLASH", "DOTCUR", "DOTDOT"),
    "method": ("UNUSUAL_METHOD",),
}


def flags_from_canonical(df: DataFrame, text: str = "canonical", keys: tuple[str, ...] = ("request_id", "label")) -> DataFrame:
    """The flags of canonical text, where the typed row is gone: keys and flag, as often as it stands there.

    A line's flags are the known flag names at its end; the [QMETA] and [HAGG] lines sum up others and are left out.
    """
    known = "^(?:" + "|".join(n for names in FAMILIES.values() for n in names) + r")(?::\S*)?\z"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\[(?:METHOD|URL|QUERY|HEADER|QSEP|FLAGS)\] "))

    def last(line: Column) -> Column:
        words = F.transform(F.array(F.reverse(F.split(line, " "))), lambda w: F.slice(w, 1, F.array_position(F.transform(w, lambda x: x.rlike(known)), False) - 1))
        return words[0]  # the tag in front is no flag, so there always is a first word that is none

    return T.unnest(df, F.flatten(F.transform(lines, last)), "flag", *keys).select(*keys, "flag")


def family_of(flag: Column) -> Column:
    name = F.substring_index(flag, ":", 1)
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for family, names in FAMILIES.items():
        out = out.when(name.isin(*names), family)
    return out.otherwise("other")


def flag_families(flags: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Flags per family and request."""
    return flags.groupBy(*keys, family_of(F.col("flag")).alias("family")).agg(F.count("*").alias("n_flags"))


def length_buckets(df: DataFrame) -> DataFrame:
    """PLEN (path), PMAX (longest parameter), HCNT (headers), HLEN (header characters) as buckets."""
    longest = F.coalesce(F.array_max(F.transform("params", lambda p: F.length(p["display"]))), F.lit(0))
    return df.select(
        "request_id",
        T.length_bucket(F.length("path")).alias("plen"),
        T.length_bucket(longest).alias("pmax"),
        T.length_bucket(F.col("hagg.h_count")).alias("hcnt"),
        T.length_bucket(F.col("hagg.total_bytes")).alias("hlen"),
    )
