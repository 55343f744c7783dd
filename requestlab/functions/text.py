"""String functions of request analysis as Catalyst expressions."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flags by character class, literal or percent-encoded.
DANGEROUS = {
    "ANGLE": r"[<>]|%3[CcEe]",
    "QUOTE": r"['\"]|%2[27]",
    "SEMICOLON": r";|%3[Bb]",
    "PAREN": r"[()]|%2[89]",
    "BRACE": r"[{}]|%7[BbDd]",
    "PIPE": r"\||%7[Cc]",
    "BACKSLASH": r"\\|%5[Cc]",
    "SPACE": r" |%20",
    "NUL": r"\x00|%00",
}
# Percent codes worth a flag when they stay encoded.
SUSPICIOUS = ("3C", "3E", "22", "27", "3B", "28", "29", "7B", "7D", "7C", "60", "24", "40")
# Shapes of query values, tried in this order; the first that matches names the shape.
SHAPES = (
    ("jwt", r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\z"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"),
    ("ipv4", r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\z"),
    ("ipv6", r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\z"),
    ("b64url", r"^[A-Za-z0-9_-]*\z"),
    ("b64", r"^[A-Za-z0-9+/]*={0,2}\z"),
    ("hex", r"^[0-9a-fA-F]+\z"),
    ("email", r"^[^@]+@[^@]+\.[^@]+\z"),
    ("uaxurl", r"(?i)^https?://[^\s/$.?#].[^\s]*\z"),
    ("num", r"^-?[0-9]+(\.[0-9]+)?\z"),
    ("lower", r"^[a-z]+\z"),
    ("upper", r"^[A-Z]+\z"),
    ("alpha", r"^[a-zA-Z]+\z"),
    ("alnum", r"^[a-zA-Z0-9]+\z"),
    ("lowernum", r"^[a-z0-9]+\z"),
    ("uppernum", r"^[A-Z0-9]+\z"),
)
#: What every value of a shape holds; cheaper to look for than the pattern.
_MARKS = {"jwt": ".", "uuid": "-", "ipv4": ".", "ipv6": ":", "email": "@", "uaxurl": "://"}
# Words in a key that hide its value.
SENSITIVE = ("password", "token", "secret", "key", "auth", "api_key", "apikey", "bearer")
SHOWN_AS_SHAPE = ("jwt", "uuid", "ipv4", "ipv6", "email", "uaxurl")

_NO_FLAGS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression: ``body`` may use it many times."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def unnest(df: DataFrame, array: str | Column, name: str, *keep: str, pos: str | None = None) -> DataFrame:
    """``keep``, the place ``pos`` if asked for, and one row for each element of an array that holds no nulls.

    The generator is an outer one: below an inner one the optimizer puts a filter on the array's
    size, pushes it to the scan and inlines there all the expressions that build the array.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())


def settle(df: DataFrame, *names: str) -> DataFrame:
    """The same table; filters on the columns ``names`` stay above this point.

    They pass an outer generator of one row, behind which the optimizer cannot reach.  Else a filter on a derived
    column goes to the scan with its whole expression inlined, once for every place where that stands.
    """
    rest = [c for c in df.columns if c not in names]
    row = F.explode_outer(F.array(F.struct(*names))).alias("_row")
    return df.select(*rest, row).select(*[F.col(f"_row.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def no_flags() -> Column:
    return F.array().cast(_NO_FLAGS)


def flag_list(*pairs: tuple[Column, str | Column]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n in pairs]))


def sorted_set(c: Column) -> Column:
    """Distinct elements in order; the array holds no nulls."""
    return let(c, lambda a: F.when(F.size(a) > 1, F.sort_array(F.array_distinct(a))).otherwise(a))


def wide(c: Column) -> Column:
    """Whether a text has characters beyond ASCII, told from its lengths."""
    return F.octet_length(c) > F.length(c)


def union_all(*cols: Column) -> Column:
    return sorted_set(F.flatten(F.array(*cols)))


def trim_framing(text: Column) -> Column:
    """Without one leading U+FEFF and without control characters (but tab, CR, LF) at both ends."""
    ctl = r"[\p{Cc}&&[^\t\r\n]]"
    edges = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(edges.rlike("﻿|" + ctl), F.regexp_replace(F.regexp_replace(text, rf"\A﻿?{ctl}*", ""), ctl + r"*\z", "")).otherwise(text)


def framing_flags(text: Column) -> Column:
    """BOMREMOVED, EDGECTRLREMOVED where :func:`trim_framing` would change something."""
    ctl = r"[\p{Cc}&&[^\t\r\n]]"
    return flag_list(
        (text.startswith("﻿"), "BOMREMOVED"),
        (F.substring(text, 1, 2).rlike(r"\A﻿?" + ctl) | F.substring(text, -1, 1).rlike(ctl), "EDGECTRLREMOVED"),
    )


def split_query_entities(query: Column) -> Column:
    """Pieces between ampersands that do not start an HTML entity; empty pieces dropped."""
    pieces = F.split(query, r"&(?!#[0-9]+;|#x[0-9a-fA-F]+;|\p{L}+;)", -1)
    return F.filter(F.coalesce(pieces, no_flags()), lambda x: x != "")


def first_token(c: Column) -> Column:
    return F.regexp_extract(c, r"(\S+)", 1)


def dangerous_flags(c: Column, skip: tuple[str, ...] = ()) -> Column:
    """Names of the classes that occur; one pattern of all of them is tried first, as most texts have none."""
    tests = {name: p for name, p in DANGEROUS.items() if name not in skip}
    return F.when(c.rlike("|".join(tests.values())), flag_list(*[(c.rlike(p), name) for name, p in tests.items()])).otherwise(no_flags())


def mixed_script(c: Column) -> Column:
    """Letters of two of Latin, Cyrillic and Greek."""
    has = [c.rlike(p).cast("int") for p in ("[A-Za-z]", r"[\x{0400}-\x{04FF}&&\p{L}]", r"[\x{0370}-\x{03FF}&&\p{L}]")]
    return wide(c) & (has[0] + has[1] + has[2] >= 2)


def unicode_flags(before: Column, after: Column) -> Column:
    """Flags of a text ``before`` and ``after`` NFKC."""
    control = after.rlike(r"\p{Cc}|%00")
    every = flag_list(
        (control, "CONTROL"),
        (before.rlike(r"[\x{FF00}-\x{FFEF}]") | (before != after), "FULLWIDTH"),
        (before.rlike(r"[\x{E000}-\x{F8FF}]|[\x{FFFE}\x{FFFF}]") | before.rlike(_nonchars()), "INVALID_UNICODE"),
        (before.rlike(r"[\x{1D400}-\x{1D7FF}]"), "MATH_UNICODE"),
        (before.rlike(r"[\x{200B}-\x{200D}\x{FEFF}\x{202A}-\x{202E}\p{Cf}]"), "UNICODE_FORMAT"),
    )
    # ASCII that NFKC left as it was can only hold controls
    return F.when(wide(before) | (before != after), every).when(control, F.array(F.lit("CONTROL"))).otherwise(no_flags())


def _nonchars() -> str:
    return "[" + "".join(rf"\x{{{plane:X}FFFE}}\x{{{plane:X}FFFF}}" for plane in range(1, 17)) + "]"


def _kept(context: str) -> str:
    """Percent codes that stay encoded: controls and space, and path delimiters in a URL."""
    return r"^%([01][0-9A-F]|20" + ("|2F|5C" if context == "URL" else "") + r")\z"


def percent_decode_once(c: Column, context: str) -> Column:
    """Every %HH becomes the character of that number (Latin-1); kept codes are upper-cased."""

    def one(x: Column) -> Column:
        code = F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("long"))
        return F.when(~x.rlike(r"^%[0-9A-Fa-f]{2}\z"), x).when(F.upper(x).rlike(_kept(context)), F.upper(x)).otherwise(code)

    parts = F.regexp_extract_all(c, F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    return F.when(c.contains("%"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def percent_flags(decoded: Column, context: str) -> Column:
    """Flags of what is still encoded after one decoding."""
    left = F.transform(F.regexp_extract_all(decoded, F.lit(r"%[0-9A-Fa-f]{2}"), F.lit(0)), F.upper)
    extra = () if context == "URL" else ("2F", "5C")
    odd = "(?i)%(?:" + "|".join((*SUSPICIOUS, *extra)) + ")"
    tests = [
        (F.exists(left, lambda x: ~x.rlike(_kept(context))), "DOUBLEPCT"),
        (decoded.rlike(r"(?i)%0[1-9A-F]|%1[0-9A-F]"), "PCTCONTROL"),
        (decoded.contains("%00"), "PCTNULL"),
        (decoded.contains("%20"), "PCTSPACE"),
        (decoded.rlike(odd), "PCTSUSPICIOUS"),
    ]
    if context == "URL":
        tests += [(decoded.rlike("(?i)%5C"), "PCTBACKSLASH"), (decoded.rlike("(?i)%2F"), "PCTSLASH")]
    return F.when(decoded.contains("%"), sorted_set(flag_list(*tests))).otherwise(no_flags())


def has_html_entity(c: Column) -> Column:
    """True if HTML unescaping would change the text.

    Numeric references count with or without semicolon; names without one are the legacy
    names, which also count as prefixes; names with one come from the public HTML5 table.
    """
    bare = sorted(n for n in html.entities.html5 if not n.endswith(";"))
    named = F.split(F.lit(" ".join(sorted(n for n in html.entities.html5 if n.endswith(";")))), " ")
    found = F.regexp_extract_all(c, F.lit(r"&([^\t\n\f <&#;]{1,32};)"), F.lit(1))
    quick = c.rlike("&(?:#[0-9]|#[xX][0-9a-fA-F]|" + "|".join(map(re.escape, bare)) + ")")
    return c.contains("&") & (quick | F.when(c.rlike("&[^\t\n\f <&#;]{1,32};"), F.arrays_overlap(found, named)).otherwise(F.lit(False)))


def url_unquote(c: Column) -> Column:
    """UTF-8 percent-decoding; plus signs and malformed percents stay."""
    safe = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(safe), c)).otherwise(c)


def value_shape(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, pattern in SHAPES:
        out = out.when(c.contains(_MARKS[name]) & c.rlike(pattern) if name in _MARKS else c.rlike(pattern), name)
    return out.otherwise("mixed")


def redact_value(key: Column, value: Column) -> Column:
    """What is shown of a value: <SECRET:shape:bytes>, <shape:bytes> or the value."""
    secret = F.lower(key).rlike("|".join(SENSITIVE))
    size = F.octet_length(value).cast("string")

    def shown(shape: Column) -> Column:
        hide = secret | (shape.isin("jwt", "hex") & (F.length(value) > 20))
        return (
            F.when(hide, F.concat(F.lit("<SECRET:"), shape, F.lit(":"), size, F.lit(">")))
            .when(shape.isin(*SHOWN_AS_SHAPE), F.concat(F.lit("<"), shape, F.lit(":"), size, F.lit(">")))
            .otherwise(value)
        )

    return let(value_shape(value), shown)


def paper_preprocess(c: Column) -> Column:
    """Decoded twice and lower-cased."""
    return F.lower(url_unquote(url_unquote(c)))


def strip_headers(c: Column) -> Column:
    """First line and what follows the first blank line, lines trimmed and joined by spaces."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def pick(ls: Column) -> Column:
        blank = F.array_position(ls, "")
        rest = F.when(blank > 0, F.slice(ls, blank.cast("int") + 1, F.size(ls))).otherwise(no_flags())
        return F.array_join(F.filter(F.concat(F.slice(ls, 1, 1), rest), lambda x: x != ""), " ")

    return let(lines, pick)


def eol_anomalies(c: Column) -> Column:
    """EOL_BARELF, EOL_BARECR, EOLMIX (two kinds of line ends), EOL_EOF_NOCRLF (the last line has no CRLF)."""
    lf, cr, crlf = c.rlike(r"(?<!\r)\n"), c.rlike(r"\r(?!\n)"), c.rlike(r"\r\n")
    kinds = lf.cast("int") + cr.cast("int") + crlf.cast("int")
    return flag_list((cr, "EOL_BARECR"), (lf, "EOL_BARELF"), (~c.endswith("\r\n"), "EOL_EOF_NOCRLF"), (kinds >= 2, "EOLMIX"))


# Upper ends of the length buckets.
BUCKET_ENDS = (15, 31, 63, 127, 255, 511, 1023)


def length_bucket(n: Column) -> Column:
    """0-15, 16-31, ... 512-1023, >1023."""
    out, low = F.when(n.isNull(), F.lit(None).cast("string")), 0
    for end in BUCKET_ENDS:
        out, low = out.when(n <= end, f"{low}-{end}"), end + 1
    return out.otherwise(f">{BUCKET_ENDS[-1]}")
