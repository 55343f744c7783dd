"""The alternative query analysis: decoded keys, its own separator rule, flags per parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestlab.functions import text as T

_DOUBLE = "%[0-9a-fA-F]{2}"


def query_params_v2(df: DataFrame, long_value: int = 1024) -> DataFrame:
    """``params2`` (key, value, display, flags), ``qsep2`` and ``qmeta2`` from the raw ``query``.

    ``;`` separates where the whole query is ``k=v(;k=v)*`` with at most half as many ``&``; then
    both separate.  QLONG counts characters; an empty key shows as <empty>; QMETA leaves QREPEAT out.
    """
    q = F.coalesce(F.col("query"), F.lit(""))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    semis, amps = count(q, ";"), count(q, "&")
    dominant = (semis > 0) & (amps <= F.floor(semis / 2)) & q.rlike(r"^(?U)\w+=[^;&]*(?:;\w+=[^;&]*)*$")
    both = F.filter(F.split(q, "[;&]", -1), lambda x: x != "")
    tokens = F.when(dominant, both).otherwise(T.split_query_entities(q))
    df = df.withColumns({"_t": tokens, "qsep2": T.flag_list((dominant, "QSEMISEP"), (q.contains(";") & ~dominant, "QRAWSEMI"))})

    def split(x: Column) -> Column:
        bare = ~x.contains("=")
        key = T.url_unquote(F.when(bare, x).otherwise(F.substring_index(x, "=", 1)))
        raw = F.when(bare, F.lit("")).otherwise(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1))
        return F.struct(key.alias("key"), T.url_unquote(raw).alias("value"), raw.alias("raw"), bare.alias("bare"))

    df = df.withColumn("_p", F.transform("_t", split)).withColumn("_k", F.transform("_p", lambda p: p["key"]))

    def finish(p: Column) -> Column:
        shown = F.when(p["key"] == "", F.lit("<empty>")).otherwise(p["key"])
        flags = T.flag_list(
            (p["bare"], "QBARE"),
            (~p["bare"] & (p["raw"] == ""), "QEMPTYVAL"),
            (p["key"].rlike(_DOUBLE) | p["value"].rlike(_DOUBLE), "DOUBLEPCT"),
            (p["value"].contains("\x00"), "QNUL"),
            (p["key"].rlike(r"[^\x00-\x7F]") | p["value"].rlike(r"[^\x00-\x7F]"), "QNONASCII"),
            (p["key"].endswith("[]"), F.concat(F.lit("QARRAY:"), shown)),
            (F.length(p["value"]) > long_value, "QLONG"),
            (F.size(F.filter("_k", lambda k: k == p["key"])) > 1, F.concat(F.lit("QREPEAT:"), shown)),
        )
        display = F.when(p["bare"], shown).otherwise(F.concat(shown, F.lit("="), p["value"]))
        return F.struct(p["key"].alias("key"), p["value"].alias("value"), display.alias("display"), flags.alias("flags"))

    df = df.withColumn("params2", F.transform("_p", finish))
    union = T.sorted_set(F.filter(F.flatten(F.transform("params2", lambda p: p["flags"])), lambda f: ~f.startswith("QREPEAT:")))
    return df.withColumn("qmeta2", F.struct(F.size("params2").alias("count"), union.alias("flags"))).drop("_t", "_p", "_k")


def render_v2(df: DataFrame) -> DataFrame:
    """``lines2``: [QPARAM], [QSEP] and [QMETA] lines."""
    line = lambda tag, body, flags: F.concat_ws(" ", F.lit(tag), body, F.nullif(F.array_join(flags, " "), F.lit("")))
    params = F.transform("params2", lambda p: line("[QPARAM]", p["display"], p["flags"]))
    sep = F.when(F.size("qsep2") > 0, F.array(F.concat(F.lit("[QSEP] "), F.array_join("qsep2", " ")))).otherwise(T.no_flags())
    meta = F.array(line("[QMETA]", F.concat(F.lit("count="), F.col("qmeta2.count").cast("string")), F.col("qmeta2.flags")))
    return df.withColumn("lines2", F.when(F.col("qmeta2.count") > 0, F.concat(params, sep, meta)).otherwise(T.no_flags()))
