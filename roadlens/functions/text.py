"""Text expressions for news articles and pages. All are built-in Spark expressions
(regex, translate, parse_url, hashes, higher-order array functions); rule sets are
arguments, so the same operator runs on any language with its own rule table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .timefn import LOCAL_TZ, col_


# ---------------------------------------------------------------- accents
def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is a base letter plus combining marks,
    mapped to that base letter (built from Unicode data, Latin blocks)."""
    src, dst = [], []
    ranges = [(0x00C0, 0x024F), (0x1E00, 0x1EFF)]
    for lo, hi in ranges:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            nfd = unicodedata.normalize("NFD", ch)
            if len(nfd) > 1 and all(unicodedata.category(m) == "Mn" for m in nfd[1:]) and len(nfd[0]) == 1:
                src.append(ch)
                dst.append(nfd[0])
    return "".join(src), "".join(dst)


_ACC_SRC, _ACC_DST = _accent_table()


def strip_accents(c) -> Column:
    """Drop combining marks from Latin letters (NFD + remove Mn), like DuckDB ``strip_accents``."""
    return F.translate(col_(c), _ACC_SRC, _ACC_DST)


def remove_accents(c) -> Column:
    """lower, strip accents, then map đ -> d."""
    return F.replace(strip_accents(F.lower(col_(c))), F.lit("đ"), F.lit("d"))


def remove_accents_lower(c) -> Column:
    """``remove_accents`` of a column in lower case already; an ASCII text is left as it is."""
    c = col_(c)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.replace(strip_accents(c), F.lit("đ"), F.lit("d")))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def normalize_unicode(c) -> Column:
    """NFC normalisation (no Spark built-in): an Arrow-batched pandas UDF."""
    return _nfc(col_(c))


# ---------------------------------------------------------------- HTML
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def _entity_names() -> Column:
    """Named entities -> character, from the standard library's HTML table."""
    from html.entities import name2codepoint

    return F.create_map(*[F.lit(x) for name, cp in sorted({**name2codepoint, "apos": 39}.items()) for x in (f"&{name};", chr(cp))])


def _entity_char(e: Column) -> Column:
    digits = F.regexp_extract(e, r"^&#([0-9]+);$", 1)
    hexes = F.regexp_extract(e, r"^&#[xX]([0-9a-fA-F]+);$", 1)
    code = F.when(digits != "", digits.cast("bigint")).when(hexes != "", F.conv(hexes, 16, 10).cast("bigint"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(numeric, F.element_at(_entity_names(), e), e)


def unescape(c) -> Column:
    """Named and numeric entities -> characters (``&nbsp;`` as a plain space). Each kind of entity that a text holds is replaced
    once; ``&amp;`` comes last, so what it uncovers stays."""
    text = col_(c)
    kinds = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_ENTITY})"), 1)), lambda e: e != "&amp;")
    out = F.aggregate(kinds, text, lambda a, e: F.replace(a, e, F.replace(_entity_char(e), F.lit("\u00a0"), F.lit(" "))))
    return F.when(F.contains(text, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def clean_html(c) -> Column:
    """Unescape entities, drop script/style blocks and tags, collapse whitespace, trim. A text without ``&`` and ``<`` has no
    entity and no tag."""
    text = col_(c)
    out = F.regexp_replace(unescape(text), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.when(has_markup(text), out).otherwise(text)
    for space in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(space), F.lit(" "))
    # a lambda, so that what its argument stands for is computed once; lone spaces need no pattern
    return F.trim(F.transform(F.array(out), lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))[0])


def has_markup(c: Column) -> Column:
    return F.contains(c, F.lit("&")) | F.contains(c, F.lit("<"))


def extract_image_url(c) -> Column:
    """First ``<img src=...>`` value (entities decoded), else null."""
    m = F.regexp_extract(col_(c), r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1)
    return F.when(F.contains(col_(c), F.lit("<")) & (m != ""), unescape(m))


def has_html(c) -> Column:
    return F.contains(col_(c), F.lit("<")) & col_(c).rlike(r"<[^>]+>")


# ---------------------------------------------------------------- tokens, titles
def normalized_title(c) -> Column:
    """Accents off, anything but [a-z0-9 whitespace] -> space, collapse spaces."""
    t = F.regexp_replace(remove_accents(c), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title_tokens(c, stopwords: Sequence[str] = ()) -> Column:
    """lower, no accents, tokens [a-z0-9]+ longer than 1 char, stopwords removed, order kept."""
    toks = F.regexp_extract_all(remove_accents(c), F.lit(r"([a-z0-9]+)"), 1)
    stops = F.array(*[F.lit(s) for s in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(toks, lambda x: (F.length(x) > 1) & ~F.array_contains(stops, x))


# ---------------------------------------------------------------- URLs
def _url_parts(c) -> tuple[Column, Column, Column, Column]:
    """Scheme (lower case; empty if there is none), host, path and query of a trimmed URL."""
    u = F.trim(col_(c))
    at = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    return (F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(u, at + r"([^/?#]*)", 1),
            F.regexp_extract(u, at + r"[^/?#]*([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1))


def _url_decode(c: Column) -> Column:
    """Form decoding; a percent sign that starts no code stands for itself."""
    return F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _url_encode(c: Column) -> Column:
    """Form encoding with the tilde left alone and the asterisk encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query_items(query: Column) -> Column:
    """Array of (k, v), decoded; an item without '=' has the value ''."""
    item = lambda p: F.struct(_url_decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"), _url_decode(F.regexp_extract(p, r"(?s)=(.*)$", 1)).alias("v"))
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), item)


def _query_text(items: Column) -> Column:
    """'?' and the items encoded, or nothing."""
    q = F.array_join(F.transform(items, lambda x: F.concat(_url_encode(x["k"]), F.lit("="), _url_encode(x["v"]))), "&")
    return F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))


def canonical_url(c) -> Column:
    """lower scheme and host, collapse '//' in the path and strip the trailing '/', decode the query, drop
    utm_*/fbclid/gclid/yclid parameters, sort by name and value, encode again, drop the fragment."""
    scheme, host, path, query = _url_parts(c)
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    path = F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"/+$", "")
    kept = F.filter(_query_items(query), lambda x: ~F.lower(x["k"]).rlike(r"^(utm_[\s\S]*|fbclid|gclid|yclid)$"))
    return F.concat(scheme, F.lit("://"), F.lower(host), path, _query_text(F.array_sort(kept)))


def feed_url(c) -> Column:
    """The form that feed items are matched by: utm_*/fbclid/gclid parameters, fragment and the path's trailing '/' go; order and
    host stay."""
    scheme, host, path, query = _url_parts(c)
    kept = F.filter(_query_items(query), lambda x: ~F.lower(x["k"]).rlike(r"^(utm_[\s\S]*|fbclid|gclid)$"))
    return F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, r"/+$", ""), _query_text(kept))


def dedup_url(c) -> Column:
    """The form that events are compared by: parameters with an empty value go, and those whose name begins with utm_, fbclid, gclid, ref or
    source; values of one name stand together at its first place; fragment and the trailing '/' of the whole go."""
    scheme, host, path, query = _url_parts(c)
    kept = F.filter(_query_items(query), lambda x: (x["v"] != "") & ~x["k"].rlike(r"^(utm_|fbclid|gclid|ref|source)"))
    names = F.array_distinct(F.transform(kept, lambda x: x["k"]))
    placed = F.transform(kept, lambda x, i: F.struct(F.array_position(names, x["k"]).alias("at"), i.alias("i"), x["k"].alias("k"), x["v"].alias("v")))
    return F.regexp_replace(F.concat(scheme, F.lit("://"), host, path, _query_text(F.array_sort(placed))), r"/+$", "")


def url_domain(c) -> Column:
    host = F.lower(F.regexp_extract(F.trim(col_(c)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def url_path(c) -> Column:
    return F.regexp_extract(F.trim(col_(c)), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


# Section of a known source name, and suffix aliases.
SOURCE_SECTION_BY_SOURCE = {
    "vnexpress_giaothong": "giao_thong", "tuoitre_giaothong": "giao_thong", "baoxaydung_giaothong": "giaothong",
    "baoxaydung_atgt": "atgt", "baoxaydung_gt24h": "gt24h", "dantri_thoisux": "thoi_su",
    "thanhnien_thoisux": "thoi_su", "vietnamnet_thoisux": "thoi_su",
}
SOURCE_SECTION_MAP = {"giaothong": "giaothong", "giao_thong": "giao_thong", "atgt": "atgt", "gt24h": "gt24h",
                      "thoisux": "thoi_su", "thoi_su": "thoi_su"}


def _map_lit(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def source_section(c) -> Column:
    s = F.lower(F.trim(col_(c)))
    # split("_", 1): everything after the first underscore
    suffix = F.when(F.instr(s, "_") > 0, F.trim(F.substr(s, F.instr(s, "_") + 1)))
    by_suffix = F.coalesce(F.element_at(_map_lit(SOURCE_SECTION_MAP), suffix), F.when(suffix != "", suffix))
    return F.coalesce(F.element_at(_map_lit(SOURCE_SECTION_BY_SOURCE), s), by_suffix)


def sha256_or_null(c) -> Column:
    c = col_(c)
    return F.when(c.isNotNull() & (c != ""), F.sha2(c, 256))


# ---------------------------------------------------------------- times in text
def _local_to_utc(ts_local: Column) -> Column:
    return F.to_utc_timestamp(ts_local, LOCAL_TZ).cast("timestamp_ntz")


def time_from_url(c) -> Column:
    """Path timestamp: first valid 14-digit 20yyMMddHHmmss, else the first valid sliding
    12-digit yyMMddHHmmss window with yy in 20..39 inside runs of >= 12 digits; local -> UTC."""
    path = url_path(c)
    fourteen = F.regexp_extract_all(path, F.lit(r"(20\d{12})"), 1)
    full = F.filter(F.transform(fourteen, lambda s: F.try_to_timestamp(s, F.lit("yyyyMMddHHmmss"))), lambda x: x.isNotNull())
    runs = F.regexp_extract_all(path, F.lit(r"(\d{12,})"), 1)

    def windows(run):
        starts = F.sequence(F.lit(0), F.length(run) - 12)
        cand = F.transform(starts, lambda i: F.substring(run, i + 1, 12))
        cand = F.filter(cand, lambda s: F.substring(s, 1, 2).cast("int").between(20, 39))
        return F.transform(cand, lambda s: F.try_to_timestamp(F.concat(F.lit("20"), s), F.lit("yyyyMMddHHmmss")))

    short = F.filter(F.flatten(F.transform(runs, windows)), lambda x: x.isNotNull())
    local = F.coalesce(F.try_element_at(full, F.lit(1)), F.try_element_at(short, F.lit(1)))
    return _local_to_utc(local.cast("timestamp_ntz"))


def time_from_text(c, now: str) -> Column:
    """``d/m/yyyy`` (or with '-') at local midnight; else ``d/m`` in the year of ``now``; local -> UTC."""
    t = col_(c)
    full = F.regexp_extract(t, r"\b(\d{1,2})[/-](\d{1,2})[/-](20\d{2})\b", 0)
    short = F.regexp_extract(t, r"\b(\d{1,2})[/-](\d{1,2})\b", 0)
    year = F.year(F.lit(now).cast("timestamp_ntz"))

    def mk(y, m, d):
        return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), F.lit("yyyy-MM-dd"))

    a = F.when(full != "", mk(F.regexp_extract(full, r"(\d+)[/-](\d+)[/-](\d+)", 3), F.regexp_extract(full, r"(\d+)[/-](\d+)", 2),
                             F.regexp_extract(full, r"(\d+)", 1)))
    b = F.when(short != "", mk(year, F.regexp_extract(short, r"(\d+)[/-](\d+)", 2), F.regexp_extract(short, r"(\d+)", 1)))
    return _local_to_utc(F.when(full != "", a).otherwise(b).cast("timestamp_ntz"))


def parse_utc(c) -> Column:
    """ISO text (with or without zone, zone-less read as UTC) -> UTC wall clock NTZ."""
    return F.try_to_timestamp(col_(c).cast("string")).cast("timestamp_ntz")


# ---------------------------------------------------------------- rules -> expressions
def first_alias_rank(text: Column, rules: dict[str, Sequence[str]]) -> Column:
    """Name of the first rule (in dict order) with any keyword contained in ``text``."""
    expr = None
    for name, words in rules.items():
        cond = None
        for w in words:
            one = F.contains(text, F.lit(w))
            cond = one if cond is None else cond | one
        if cond is None:
            continue
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr if expr is not None else F.lit(None).cast("string")


def first_keyword(text: Column, rules: dict[str, Sequence[str]]) -> Column:
    """The first matching keyword of the first matching rule."""
    out = None
    for _, words in rules.items():
        for w in words:
            cond = F.contains(text, F.lit(w))
            out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
    return out if out is not None else F.lit(None).cast("string")


def first_match(text: Column, rules: dict[str, Sequence[str]]) -> Column:
    """struct(name, keyword): ``first_alias_rank`` and ``first_keyword`` with one look for each keyword; nulls when none."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit("").alias("keyword")))
    for name, words in rules.items():
        for w in words:
            found = found.when(F.contains(text, F.lit(w)), F.struct(F.lit(name).alias("name"), F.lit(w).alias("keyword")))
    return found


def any_keyword(text: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond
