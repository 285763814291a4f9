"""Row-level column expressions (all JVM-side, no Python UDFs).

Python's ``a or b`` treats NULL, '' , 0 and empty containers as missing; the
helpers here make that rule explicit so that plain ``coalesce`` (which only
skips NULL) is never used by mistake.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- falsy-coalesce ---------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nonblank(c) -> Column:
    """NULL when the string is NULL or empty (Python falsiness for str)."""
    c = _c(c)
    return F.when(c != "", c)


def falsy_coalesce(*cols, default: str = "") -> Column:
    """``a or b or ... or default`` for strings."""
    return F.coalesce(*[nonblank(c) for c in cols], F.lit(default))


def nonempty(c) -> Column:
    """NULL when the array/map is NULL or empty."""
    c = _c(c)
    return F.when(F.size(c) > 0, c)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# -- ids and URLs -----------------------------------------------------------

STATUS_ID_PATTERN = r"(?U)/status/(\d+)"
DEFAULT_URL_PREFIX = "https://x.com/"


def extract_id(url) -> Column:
    """Numeric id from the first ``/status/<digits>``; '' when absent or NULL."""
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), STATUS_ID_PATTERN, 1)


def default_url(id_col, handle=None) -> Column:
    """``https://x.com/<handle>/status/<id>`` or the ``/i/`` form without handle."""
    id_col = _c(id_col)
    plain = F.concat(F.lit(DEFAULT_URL_PREFIX + "i/status/"), id_col)
    if handle is None:
        return plain
    handle = _c(handle)
    return F.when(F.coalesce(handle, F.lit("")) != "",
                  F.concat(F.lit(DEFAULT_URL_PREFIX), handle, F.lit("/status/"), id_col)
                  ).otherwise(plain)


def safe_url(url) -> Column:
    """Keep http(s) URLs (scheme case-insensitive), otherwise '#'."""
    url = _c(url)
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(low.startswith("http://") | low.startswith("https://"), url).otherwise(F.lit("#"))


# An IPv6 address: eight groups, or fewer around one "::", the last two possibly as a dotted quad.
_GROUP, _QUAD = "[0-9a-f]{1,4}", r"(?:\d{1,3}\.){3}\d{1,3}"
IPV6 = (rf"^(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{6}}{_QUAD}"
        rf"|(?!.*::.*::)(?!(?:{_GROUP}:+){{7}}{_GROUP})(?:{_GROUP}:)*(?:{_GROUP})?::(?:{_GROUP}:)*(?:{_GROUP}|{_QUAD})?)$")


def link_hosts(links) -> Column:
    """Lower-cased hosts of a link array: userinfo/port dropped, one ``www.``
    removed, links without a network location skipped; of a bracketed IPv6
    address what stands between the brackets, if it is one."""
    place = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?"

    def host(u: Column) -> Column:
        u = F.coalesce(u, F.lit(""))
        bracketed = F.lower(F.regexp_extract(u, place + r"\[([^\[\]/?#]*)\][^/?#]*(?:[/?#]|$)", 1))
        named = F.regexp_replace(F.lower(F.regexp_extract(u, place + r"([^/?#:\[]*)", 1)), r"^www\.", "")
        return F.when(bracketed.rlike(IPV6), bracketed).otherwise(named)
    return F.filter(F.transform(F.coalesce(_c(links), F.array().cast("array<string>")), host), lambda h: h != "")


# -- text assembly ----------------------------------------------------------


def keyword_haystack(text="text", hashtags="hashtags", links="links", handle="author_handle") -> Column:
    """Text, hashtags, links and handle, lower-cased, parts joined by two spaces."""
    def joined(a):
        return F.lower(F.array_join(F.coalesce(_c(a), F.array().cast("array<string>")), " "))

    return F.concat_ws("  ",
                       F.lower(F.coalesce(_c(text), F.lit(""))),
                       joined(hashtags),
                       joined(links),
                       F.lower(F.coalesce(_c(handle), F.lit(""))))


def search_haystack() -> Column:
    """text, summary, topic, handle, name, tags joined by one space, lower-cased."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in
             ("text", "summary", "topic", "author_handle", "author_name")]
    parts.append(F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " "))
    return F.lower(F.concat_ws(" ", *parts))


def html_escape(c) -> Column:
    """Escape & < > " ' the way the listing page does."""
    c = F.coalesce(_c(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def catalog_title(summary="summary", text="text", url="url") -> Column:
    """``(summary or text or url)`` with newlines as spaces, stripped."""
    t = falsy_coalesce(summary, text, url)
    return strip_ws(F.replace(t, F.lit("\n"), F.lit(" ")))


def catalog_line() -> Column:
    """``- @handle — [title](safe_url) `#id```."""
    handle = F.coalesce(F.col("author_handle"), F.lit(""))
    author = F.when(handle != "", F.concat(F.lit("@"), handle, F.lit(" — "))).otherwise(F.lit(""))
    return F.concat(F.lit("- "), author, F.lit("["), catalog_title(), F.lit("]("),
                    safe_url("url"), F.lit(") `#"), F.col("id"), F.lit("`"))


def script_safe_json(c) -> Column:
    """JSON text safe to embed in a script block: '<' becomes a unicode escape."""
    return F.replace(_c(c), F.lit("<"), F.lit("\\u003c"))


# -- metrics ----------------------------------------------------------------


def _js_fixed1_thousands(n: Column) -> Column:
    """``(n / 1000).toFixed(1)`` for 1000 <= n < 10000, exactly as JavaScript.

    toFixed rounds the *binary* value of n/1000 half-up.  On a decimal tie
    (n % 100 == 50) the direction depends on whether the double lies above or
    below n/1000; its sign is found exactly with a Dekker split product.
    """
    d = n.cast("double") / F.lit(1000.0)
    c = d * F.lit(134217729.0)
    hi = c - (c - d)
    lo = d - hi
    p = d * F.lit(1000.0)
    err = (hi * F.lit(1000.0) - p) + lo * F.lit(1000.0)
    above_or_exact = ((p - n.cast("double")) + err) >= 0
    tenths = F.floor(n / 100).cast("bigint")
    tie = (n % 100) == 50
    up = F.when(tie, above_or_exact).otherwise((n % 100) > 50)
    t = tenths + F.when(up, 1).otherwise(0)
    return F.concat((t / 10).cast("bigint").cast("string"), F.lit("."), (t % 10).cast("string"))


def format_metric(n) -> Column:
    """Abbreviate a count: n >= 1000 -> 'k' with one decimal below 10000."""
    n = _c(n).cast("bigint")
    whole = F.floor((n + 500) / 1000).cast("bigint").cast("string")
    return (F.when(n >= 10000, F.concat(whole, F.lit("k")))
            .when(n >= 1000, F.concat(_js_fixed1_thousands(n), F.lit("k")))
            .otherwise(n.cast("string")))


def metrics_line(metrics="metrics") -> Column:
    """'♥ likes · ▶ views · ⌂ bookmarks', zero/missing parts skipped."""
    m = _c(metrics)

    def part(key, sym):
        v = F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0))
        return F.when(v != 0, F.concat(F.lit(sym + " "), html_escape(format_metric(v))))

    return F.concat_ws(" · ", part("likes", "♥"), part("views", "▶"), part("bookmarks", "⌂"))


def metric(metrics, key: str) -> Column:
    """A metric value, missing or NULL as 0."""
    return F.coalesce(F.try_element_at(_c(metrics), F.lit(key)), F.lit(0)).cast("bigint")


# -- dates ------------------------------------------------------------------


# FIXED VALUES: English month abbreviations, in calendar order (RFC 2822).
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _month_number(name: Column) -> Column:
    pos = F.instr(F.lit(MONTHS), F.lower(name))
    return F.when((F.length(name) == 3) & (pos > 0) & (pos % 4 == 1), (pos + 3) / 4).cast("int")


# FIXED VALUES: English day abbreviations from Sunday (dayofweek() = 1).
DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def ntz_iso(ts: Column) -> Column:
    """'yyyy-MM-ddTHH:mm:ss' of a TIMESTAMP_NTZ with whole seconds.

    Built from the cast text, not ``date_format``: formatting goes through
    the session zone and shifts wall times that fall in a DST gap.
    """
    return F.replace(F.substring(ts.cast("string"), 1, 19), F.lit(" "), F.lit("T"))


def ntz_x_style(ts: Column, offset: str = "+0000") -> Column:
    """'Wed Oct 10 20:19:24 +0000 2018' for a TIMESTAMP_NTZ wall clock."""
    text = ts.cast("string")
    day = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.dayofweek(ts))
    mon = F.initcap(F.element_at(F.split(F.lit(MONTHS), " "), F.month(ts)))
    return F.concat_ws(" ", day, mon, F.substring(text, 9, 2), F.substring(text, 12, 8), F.lit(offset),
                       F.substring(text, 1, 4))


def ntz_rfc(ts: Column, offset: str = "+0000") -> Column:
    """'Wed, 10 Oct 2018 20:19:24 +0000' for a TIMESTAMP_NTZ wall clock."""
    text = ts.cast("string")
    day = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.dayofweek(ts))
    mon = F.initcap(F.element_at(F.split(F.lit(MONTHS), " "), F.month(ts)))
    return F.concat(day, F.lit(", "), F.concat_ws(" ", F.substring(text, 9, 2), mon, F.substring(text, 1, 4),
                                                   F.substring(text, 12, 8), F.lit(offset)))


def _iso_text(wall: Column, micro: Column | None, offset: Column) -> Column:
    frac = F.lit("") if micro is None else F.coalesce(micro, F.lit(""))
    return F.when(wall.isNotNull(), F.concat(ntz_iso(wall), frac, offset))


# Day names and the zone names of RFC 2822.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "AST": "-0400", "ADT": "-0300", "EST": "-0500",
         "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_created_at(c) -> Column:
    """RFC-2822 / X-style / ISO text -> ISO-8601 text; NULL when unparseable.

    The original UTC offset is kept (``+00:00`` for ``Z``/``+0000``); an ISO
    input without an offset stays naive.  The wall clock is rebuilt from the
    text fields (``try_make_timestamp_ntz``), so the session time zone never
    matters.
    """
    s = strip_ws(F.coalesce(_c(c), F.lit("")))
    nowd = F.regexp_replace(s, r"^(?i)(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in DAY_NAMES) + r"),?\s+", "")
    t = F.split(nowd, "[ :]")
    x_shape = nowd.rlike(r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$")
    rfc = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([+-]\d{4}|[A-Za-z]{1,5}))?$"
    r_shape = nowd.rlike(rfc)

    def el(i):
        return F.get(t, i)

    def off(tok):
        return F.concat(F.substring(tok, 1, 3), F.lit(":"), F.substring(tok, 4, 2))

    def wall(y, mo, d, hh, mi, ss):
        return F.try_make_timestamp_ntz(y.cast("int"), mo, d.cast("int"), hh.cast("int"), mi.cast("int"),
                                        ss.cast("decimal(16,6)"))

    x_form = _iso_text(wall(el(6), _month_number(el(0)), el(1), el(2), el(3), el(4)), None, off(el(5)))

    def rp(i):
        return F.regexp_extract(nowd, rfc, i)

    zone = F.upper(rp(7))
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), zone), F.lit("-0000"))
    zone = F.when(zone.rlike("^[+-]"), zone).otherwise(known)
    # "-0000" (also an unknown or missing zone) says that the offset isn't known: the time stays naive
    zone = F.when(zone == "-0000", F.lit("")).otherwise(off(zone))
    r_form = _iso_text(wall(rp(3), _month_number(rp(2)), rp(1), rp(4), rp(5),
                            F.when(rp(6) == "", "0").otherwise(rp(6))), None, zone)
    m_i = (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?)?"
           r"(Z|[+-]\d{2}:?\d{2})?$")
    iso = F.split(F.regexp_replace(s, m_i, "$1,$2,$3,$4,$5,$6,$7,$8"), ",")
    parts = F.when(s.rlike(m_i), iso)

    def p(i):
        return F.get(parts, i)

    def or0(x):
        return F.when(x != "", x).otherwise(F.lit("0"))

    frac = p(6)
    micro = F.when((frac != "") & (F.rpad(frac, 6, "0") != "000000"), F.concat(F.lit("."), F.rpad(frac, 6, "0")))
    o = p(7)
    i_off = (F.when(o == "", F.lit("")).when(o == "Z", F.lit("+00:00"))
             .otherwise(F.concat(F.substring(o, 1, 3), F.lit(":"), F.substring(o, -2, 2))))
    i_form = _iso_text(wall(p(0), p(1).cast("int"), p(2), or0(p(3)), or0(p(4)), or0(p(5))), micro, i_off)
    return (F.when(s == "", F.lit(None).cast("string"))
            .when(x_shape, x_form)
            .when(r_shape, r_form)
            .otherwise(i_form))


# -- JSON/variant -----------------------------------------------------------


def coerce_metrics(v) -> Column:
    """Keep only integer-convertible metric values of a VARIANT object.

    true -> 1, 3.9 -> 3, "10" -> 10; "3.7", HTML strings and objects dropped;
    a non-object yields an empty map.
    """
    m = F.try_variant_get(_c(v), "$", "map<string,variant>")
    m = F.coalesce(m, F.create_map().cast("map<string,variant>"))

    def as_int(x):
        num = F.try_variant_get(x, "$", "double")
        kind = F.schema_of_variant(x)
        text = F.try_variant_get(x, "$", "string")
        bare = strip_ws(text)
        from_text = F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("bigint"))
        exact = F.try_variant_get(x, "$", "bigint")  # a double would round large integers
        return (F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("bigint"))
                .when(kind == "STRING", from_text)
                .when(kind.startswith("BIGINT"), exact)
                .when(kind.startswith("BIGINT") | kind.startswith("INT") | kind.startswith("DECIMAL")
                      | kind.startswith("DOUBLE") | kind.startswith("FLOAT") | kind.startswith("SMALLINT")
                      | kind.startswith("TINYINT"),
                      F.when(F.isnan(num) | (F.abs(num) == float("inf")), None)
                      .otherwise(F.when(num >= 0, F.floor(num)).otherwise(F.ceil(num)).try_cast("bigint"))))

    return F.map_filter(F.transform_values(m, lambda k, x: as_int(x)), lambda k, x: x.isNotNull())
