"""Registered queries: text functions, news events and page links.

Rule tables here are test parameters that fit the driver's invented prose
(FIXTURES.md); production defaults live in ``roadlens.operators.news``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import news as N
from . import common as K
from .registry import oracle, register, round_sql, stage

# ---------------------------------------------------------------- test rule tables
TEST_RULES = [("accident", ["schä"]), ("flood", ["ción"]), ("roadwork_active", ["keit"]),
              ("weather_disruption", ["eran"]), ("planned_event", ["ment"])]
TEST_ACTIVE = ["keit"]
TEST_PLANNING = ["ung"]
TEST_INFRA = ["die"]
TEST_PLANNED = ["lich"]
TEST_LADDER = {5: ["tod"], 4: ["ción"], 3: ["schä", "keit"]}
TEST_PLANNING_LOW = ["ung"]
TEST_DAMPENING = ["bank"]
TEST_CITY_ALIASES = {"hanoi": ["ther", "eran"], "hcmc": ["tion", "ción"]}
TEST_KEYWORDS = ["tion", "ther", "ment"]
TEST_DISTRICT = [r"the\s+[a-z]+"]
TEST_ROAD = r"(?i)((?:und|and)\s+[a-z]+)"
TEST_TYPE_RULES = [("accident", ["schä"]), ("flood", ["ción"]), ("congestion", ["keit"]), ("weather", ["eran"]),
                   ("construction", ["ment"]), ("event", ["the"])]
TEST_KW_LADDER = {3: ["schä"], 2: ["ción", "keit"], 1: ["ment"]}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(w)})" for w in words) + ")" if words else "false"


def d_first_rank(text: str, rules) -> str:
    parts = [f"WHEN {d_any(text, words)} THEN {_lit(name)}" for name, words in rules if words]
    return "CASE " + " ".join(parts) + " END" if parts else "NULL"


def d_first_kw(text: str, rules) -> str:
    parts = [f"WHEN contains({text}, {_lit(w)}) THEN {_lit(w)}" for _, words in rules for w in words]
    return "CASE " + " ".join(parts) + " END" if parts else "NULL"


def d_remove_accents(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'đ', 'd')"


# DuckDB has no unescape function: the entities that the driver's pages hold, one by one
PAGE_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}


def d_clean_html(x: str) -> str:
    out = x
    for ent, ch in PAGE_ENTITIES.items():
        if ent != "&amp;":
            out = f"replace({out}, {_lit(ent)}, {_lit(ch)})"
    out = f"replace({out}, '&amp;', '&')"
    out = f"regexp_replace({out}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    return f"trim({out})"


# ---------------------------------------------------------------- simple text functions
@register("clean_html", oracle(f"SELECT page_id, {d_clean_html('html')} AS text FROM pages"))
def q_clean_html(spark, sf):
    return K.tables(spark, sf).pages.select("page_id", X.clean_html("html").alias("text"))


@register("normalize_unicode", oracle("SELECT doc_id, nfc_normalize(text) AS text FROM documents"))
def q_normalize_unicode(spark, sf):
    return K.tables(spark, sf).documents.select("doc_id", X.normalize_unicode("text").alias("text"))


@register("remove_accents", oracle(f"SELECT doc_id, {d_remove_accents('text')} AS text FROM documents"))
def q_remove_accents(spark, sf):
    return K.tables(spark, sf).documents.select("doc_id", X.remove_accents("text").alias("text"))


TEST_STOPWORDS = ["the", "and", "der", "die", "und", "les", "des", "los", "las"]


@register("title_tokens", oracle(f"""
SELECT doc_id, list_filter(regexp_extract_all({d_remove_accents('title')}, '([a-z0-9]+)', 1),
  lambda x: length(x) > 1 AND NOT list_contains([{', '.join(_lit(s) for s in TEST_STOPWORDS)}], x)) AS tokens
FROM news_raw""", "news_raw"))
def q_title_tokens(spark, sf):
    return K.tables(spark, sf).news_raw.select("doc_id", X.title_tokens("title", TEST_STOPWORDS).alias("tokens"))


def d_normalized_title(x: str) -> str:
    t = f"regexp_replace({d_remove_accents(x)}, '[^a-z0-9\\s]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@register("normalized_title", oracle(f"SELECT doc_id, {d_normalized_title('title')} AS title_norm FROM news_raw", "news_raw"))
def q_normalized_title(spark, sf):
    return K.tables(spark, sf).news_raw.select("doc_id", X.normalized_title("title").alias("title_norm"))


def d_canonical_url(u: str) -> str:
    u = f"trim({u})"
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    host = f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    path = f"regexp_replace(regexp_replace({path}, '/{{2,}}', '/', 'g'), '/+$', '')"
    kept = f"list_filter({d_query_items(u)}, lambda x: NOT regexp_matches(lower(x.k), '^(utm_.*|fbclid|gclid|yclid)$'))"
    return f"concat(CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END, '://', {host}, {path}, {d_query_text(f'list_sort({kept})')})"


def d_query_items(u: str) -> str:
    decoded = lambda x: f"url_decode(replace({x}, '+', ' '))"
    parts = f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"
    return f"list_transform({parts}, lambda p: struct_pack(k := {decoded("split_part(p, '=', 1)")}, v := {decoded("regexp_extract(p, '=(.*)$', 1)")}))"


def d_query_text(items: str) -> str:
    encoded = lambda x: f"replace(url_encode({x}), '%20', '+')"
    q = f"array_to_string(list_transform({items}, lambda x: concat({encoded('x.k')}, '=', {encoded('x.v')})), '&')"
    return f"CASE WHEN {q} <> '' THEN concat('?', {q}) ELSE '' END"


def d_url_domain(u: str) -> str:
    host = f"regexp_replace(lower(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
    return f"CASE WHEN {host} <> '' THEN {host} END"


@register("canonical_url", oracle(f"SELECT page_id, {d_canonical_url('url')} AS canonical_url FROM pages"))
def q_canonical_url(spark, sf):
    return K.tables(spark, sf).pages.select("page_id", X.canonical_url("url").alias("canonical_url"))


def d_url_variants(u: str) -> str:
    u = f"trim({u})"
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    host = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    items = d_query_items(u)
    feed = f"list_filter({items}, lambda x: NOT regexp_matches(lower(x.k), '^(utm_.*|fbclid|gclid)$'))"
    full = f"list_filter({items}, lambda x: x.v <> '' AND NOT regexp_matches(x.k, '^(utm_|fbclid|gclid|ref|source)'))"
    placed = f"list_sort(list_transform({full}, lambda x, i: struct_pack(at := list_position(list_transform({full}, lambda y: y.k), x.k), i := i, k := x.k, v := x.v)))"
    return (f"concat({scheme}, '://', {host}, regexp_replace({path}, '/+$', ''), {d_query_text(feed)}) AS feed_url, "
            f"regexp_replace(concat({scheme}, '://', {host}, {path}, {d_query_text(placed)}), '/+$', '') AS dedup_url")


@register("url_variants", oracle(f"SELECT page_id, {d_url_variants('url')} FROM pages"))
def q_url_variants(spark, sf):
    """The two laxer forms of a URL, by which feeds and events are compared."""
    return K.tables(spark, sf).pages.select("page_id", X.feed_url("url").alias("feed_url"), X.dedup_url("url").alias("dedup_url"))


@register("url_domain", oracle(f"SELECT page_id, {d_url_domain('url')} AS domain FROM pages"))
def q_url_domain(spark, sf):
    return K.tables(spark, sf).pages.select("page_id", X.url_domain("url").alias("domain"))


def d_source_section(x: str) -> str:
    s = f"lower(trim({x}))"
    by_source = "CASE " + " ".join(f"WHEN {s} = {_lit(k)} THEN {_lit(v)}" for k, v in X.SOURCE_SECTION_BY_SOURCE.items()) + " END"
    suffix = f"CASE WHEN instr({s}, '_') > 0 THEN trim(substr({s}, instr({s}, '_') + 1)) END"
    by_suffix = "CASE " + " ".join(f"WHEN {suffix} = {_lit(k)} THEN {_lit(v)}" for k, v in X.SOURCE_SECTION_MAP.items()) + \
        f" WHEN {suffix} <> '' THEN {suffix} END"
    return f"coalesce({by_source}, {by_suffix})"


@register("source_section", oracle(f"""
SELECT doc_id, {d_source_section('src')} AS section FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(source, '_giaothong') WHEN doc_id % 3 = 1 THEN concat(source, '_news') ELSE source END AS src
  FROM documents) x"""))
def q_source_section(spark, sf):
    d = K.tables(spark, sf).documents
    src = (F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("_giaothong")))
           .when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("_news"))).otherwise(F.col("source")))
    return d.select("doc_id", src.alias("source")).select("doc_id", X.source_section("source").alias("section"))


@register("content_hashes", oracle(f"""
SELECT doc_id, sha256({d_canonical_url('source_url')}) AS url_hash,
  sha256(concat(coalesce(title, ''), '|', coalesce(summary, ''))) AS content_hash, sha1(external_id) AS event_key
FROM news_raw""", "news_raw"))
def q_content_hashes(spark, sf):
    n = K.tables(spark, sf).news_raw
    return n.select("doc_id", X.sha256_or_null(X.canonical_url("source_url")).alias("url_hash"),
                    F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))), 256).alias("content_hash"),
                    F.sha1("external_id").alias("event_key"))


@register("extract_image_url", oracle("""
SELECT page_id, CASE WHEN m <> '' THEN replace(replace(replace(replace(replace(replace(replace(replace(m, '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') END AS image_url
FROM (SELECT page_id, regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1) AS m FROM pages) x"""))
def q_extract_image_url(spark, sf):
    return K.tables(spark, sf).pages.select("page_id", X.extract_image_url("html").alias("image_url"))


def d_extract_first(text: str, patterns, lower=True) -> str:
    t = f"lower({text})" if lower else text
    parts = [f"CASE WHEN regexp_extract({t}, {_lit(p)}, 0) <> '' THEN trim(regexp_replace(regexp_extract({t}, {_lit(p)}, 0), '\\s+', ' ', 'g')) END" for p in patterns]
    return f"coalesce({', '.join(parts)})" if len(parts) > 1 else parts[0]


NEWS_TEXT = "concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))"


@register("extract_district", oracle(f"SELECT doc_id, {d_extract_first(d_clean_html(NEWS_TEXT), TEST_DISTRICT)} AS district FROM news_raw", "news_raw"))
def q_extract_district(spark, sf):
    n = K.tables(spark, sf).news_raw
    return n.select("doc_id", N.extract_first(N.full_text("title", "summary"), TEST_DISTRICT).alias("district"))


@register("extract_road", oracle(f"""
SELECT doc_id, CASE WHEN regexp_extract(t, {_lit(TEST_ROAD)}, 1) <> '' THEN trim(regexp_replace(regexp_extract(t, {_lit(TEST_ROAD)}, 1), '\\s+', ' ', 'g')) END AS road_name
FROM (SELECT doc_id, {d_clean_html(NEWS_TEXT)} AS t FROM news_raw) x""", "news_raw"))
def q_extract_road(spark, sf):
    n = K.tables(spark, sf).news_raw
    t = N.full_text("title", "summary")
    m = F.regexp_extract(t, TEST_ROAD, 1)
    return n.select("doc_id", F.when(m != "", F.trim(F.regexp_replace(m, r"\s+", " "))).alias("road_name"))


def d_time_from_url(u: str) -> str:
    path = f"regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    full = f"list_filter(list_transform(regexp_extract_all({path}, '(20\\d{{12}})', 1), lambda s: try_strptime(s, '%Y%m%d%H%M%S')), lambda x: x IS NOT NULL)"
    win = ("list_transform(list_filter(list_transform(range(0, length(r) - 11), lambda i: substr(r, i + 1, 12)), "
           "lambda s: TRY_CAST(substr(s, 1, 2) AS INTEGER) BETWEEN 20 AND 39), lambda s: try_strptime(concat('20', s), '%Y%m%d%H%M%S'))")
    short = f"list_filter(flatten(list_transform(regexp_extract_all({path}, '(\\d{{12,}})', 1), lambda r: {win})), lambda x: x IS NOT NULL)"
    return f"(coalesce({full}[1], {short}[1]) - INTERVAL 7 HOUR)"


@register("time_from_url", oracle(f"""
SELECT page_id, {d_time_from_url('u')} AS url_time FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, '/news-20240115093000123.htm')
    WHEN page_id % 3 = 1 THEN concat(url, '/a-1924011509300077.htm') ELSE url END AS u FROM pages) x"""))
def q_time_from_url(spark, sf):
    p = K.tables(spark, sf).pages
    u = (F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/news-20240115093000123.htm")))
         .when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/a-1924011509300077.htm"))).otherwise(F.col("url")))
    return p.select("page_id", X.time_from_url(u).alias("url_time"))


def d_time_from_text(t: str, now: str) -> str:
    full = f"regexp_extract({t}, '\\b(\\d{{1,2}})[/-](\\d{{1,2}})[/-](20\\d{{2}})\\b', 0)"
    short = f"regexp_extract({t}, '\\b(\\d{{1,2}})[/-](\\d{{1,2}})\\b', 0)"
    mk = lambda y, m, d: f"try_strptime(printf('%04d-%02d-%02d', CAST({y} AS INTEGER), CAST({m} AS INTEGER), CAST({d} AS INTEGER)), '%Y-%m-%d')"
    a = mk(f"regexp_extract({full}, '(\\d+)[/-](\\d+)[/-](\\d+)', 3)", f"regexp_extract({full}, '(\\d+)[/-](\\d+)', 2)", f"regexp_extract({full}, '(\\d+)', 1)")
    b = mk(f"year(TIMESTAMP '{now}')", f"regexp_extract({short}, '(\\d+)[/-](\\d+)', 2)", f"regexp_extract({short}, '(\\d+)', 1)")
    return f"(CASE WHEN {full} <> '' THEN {a} WHEN {short} <> '' THEN {b} END - INTERVAL 7 HOUR)"


@register("time_from_text", oracle(f"""
SELECT doc_id, {d_time_from_text('t', K.TEST_NOW)} AS text_time FROM (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat(title, ' ', CAST(1 + doc_id % 28 AS VARCHAR), '/', CAST(1 + doc_id % 12 AS VARCHAR), '/2024')
    WHEN doc_id % 4 = 1 THEN concat(title, ' ', CAST(1 + doc_id % 31 AS VARCHAR), '-', CAST(1 + doc_id % 13 AS VARCHAR))
    ELSE title END AS t FROM news_raw) x""", "news_raw"))
def q_time_from_text(spark, sf):
    n = K.tables(spark, sf).news_raw
    d = F.col("doc_id")
    t = (F.when(d % 4 == 0, F.concat_ws("", F.col("title"), F.lit(" "), (1 + d % 28).cast("string"), F.lit("/"), (1 + d % 12).cast("string"), F.lit("/2024")))
         .when(d % 4 == 1, F.concat_ws("", F.col("title"), F.lit(" "), (1 + d % 31).cast("string"), F.lit("-"), (1 + d % 13).cast("string")))
         .otherwise(F.col("title")))
    return n.select("doc_id", X.time_from_text(t, K.TEST_NOW).alias("text_time"))


# ---------------------------------------------------------------- classification
def d_classify(text: str) -> tuple[str, str]:
    low = f"lower({text})"
    act = d_first_kw(low, [("a", TEST_ACTIVE)])
    plan = d_first_kw(low, [("p", TEST_PLANNING)])
    planning_case = f"({plan} IS NOT NULL AND {act} IS NULL AND {d_any(low, TEST_INFRA)})"
    planning_cat = f"CASE WHEN {d_any(low, TEST_PLANNED)} THEN 'roadwork_planned' ELSE 'infrastructure_planning' END"
    ordered = [("roadwork_active", TEST_ACTIVE)] + [r for r in TEST_RULES if r[0] != "roadwork_active"]
    cat = (f"CASE WHEN {planning_case} THEN {planning_cat} WHEN {act} IS NOT NULL THEN coalesce({d_first_rank(low, ordered)}, 'unrelated') "
           f"ELSE coalesce({d_first_rank(low, TEST_RULES)}, 'unrelated') END")
    sub = (f"CASE WHEN {planning_case} THEN {plan} WHEN {act} IS NOT NULL THEN coalesce({d_first_kw(low, ordered)}, 'unrelated') "
           f"ELSE coalesce({d_first_kw(low, TEST_RULES)}, 'unrelated') END")
    return cat, sub


def classify_test(text):
    return N.classify_event(text, TEST_RULES, TEST_PLANNING, TEST_ACTIVE, TEST_INFRA, TEST_PLANNED)


_CAT, _SUB = d_classify("t")


@register("classify_event", oracle(f"""
SELECT doc_id, {_CAT} AS event_category, {_SUB} AS event_subtype FROM (SELECT doc_id, {d_clean_html(NEWS_TEXT)} AS t FROM news_raw) x""", "news_raw"))
def q_classify_event(spark, sf):
    c = classify_test(N.full_text("title", "summary"))
    return K.tables(spark, sf).news_raw.select("doc_id", c["category"].alias("event_category"), c["subtype"].alias("event_subtype"))


@register("classify_event_type", oracle(f"""
SELECT doc_id, coalesce({d_first_rank('lower(t)', TEST_TYPE_RULES)}, 'other') AS event_type
FROM (SELECT doc_id, concat(coalesce(title, ''), ' ', coalesce(summary, '')) AS t FROM news_raw) x""", "news_raw"))
def q_classify_event_type(spark, sf):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return K.tables(spark, sf).news_raw.select("doc_id", N.classify_event_type(t, TEST_TYPE_RULES).alias("event_type"))


def _strip(w):
    return N._strip(w)


@register("detect_categories", oracle(f"""
SELECT doc_id, CASE WHEN len(h) > 0 THEN array_to_string(h, ';') END AS categories FROM (
SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {d_any(d_remove_accents('t'), [_strip(w) for w in words])} THEN {_lit(c)} END" for c, words in TEST_RULES)}],
  lambda x: x IS NOT NULL) AS h
FROM (SELECT doc_id, concat(coalesce(title, ''), ' ', coalesce(summary, '')) AS t FROM news_raw) x) y""", "news_raw"))
def q_detect_categories(spark, sf):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return K.tables(spark, sf).news_raw.select("doc_id", N.detect_categories(t, dict(TEST_RULES)).alias("categories"))


def d_severity(cat: str, text: str) -> str:
    low = f"lower({text})"
    parts = [f"WHEN {cat} = 'unrelated' THEN 0"]
    for level in sorted(TEST_LADDER, reverse=True):
        parts.append(f"WHEN {d_any(low, TEST_LADDER[level])} THEN {level}")
    parts.append(f"WHEN {cat} IN ('infrastructure_planning', 'roadwork_planned') THEN CASE WHEN {d_any(low, TEST_PLANNING_LOW)} THEN 1 ELSE 2 END")
    return "CASE " + " ".join(parts) + " ELSE 2 END"


def d_relevance(cat: str, sev: str, text: str) -> str:
    base = "CASE " + " ".join(f"WHEN {cat} = {_lit(k)} THEN {v!r}e0" for k, v in N.RELEVANCE_BASE.items()) + " ELSE 0e0 END"
    return (f"greatest(0e0, least(1e0, {base} + CASE WHEN {sev} >= 4 THEN 5e-2 ELSE 0e0 END "
            f"- CASE WHEN {d_any(f'lower({text})', TEST_DAMPENING)} THEN 1e-1 ELSE 0e0 END))")


def severity_test(cat, text):
    return N.score_severity(cat, text, TEST_LADDER, TEST_PLANNING_LOW)


def relevance_test(cat, sev, text):
    return N.score_relevance(cat, sev, text, N.RELEVANCE_BASE, TEST_DAMPENING)


stage("news_scored", f"""
SELECT doc_id, t, event_category, event_subtype, {d_severity('event_category', 't')} AS severity_score FROM (
  SELECT doc_id, t, {_CAT} AS event_category, {_SUB} AS event_subtype FROM (SELECT doc_id, {d_clean_html(NEWS_TEXT)} AS t FROM news_raw) a) b
""", "news_raw")


@register("score_severity", oracle("SELECT doc_id, event_category, severity_score FROM news_scored", "news_scored"))
def q_score_severity(spark, sf):
    t = N.full_text("title", "summary")
    c = classify_test(t)["category"]
    return K.tables(spark, sf).news_raw.select("doc_id", c.alias("event_category"), severity_test(c, t).alias("severity_score"))


@register("score_severity_keywords", oracle(f"""
SELECT doc_id, CASE {' '.join(f"WHEN {d_any('lower(t)', TEST_KW_LADDER[k])} THEN {k}" for k in sorted(TEST_KW_LADDER, reverse=True))} ELSE 0 END
  AS severity FROM (SELECT doc_id, concat(coalesce(title, ''), ' ', coalesce(summary, '')) AS t FROM news_raw) x""", "news_raw"))
def q_score_severity_keywords(spark, sf):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return K.tables(spark, sf).news_raw.select("doc_id", N.score_severity_keywords(t, TEST_KW_LADDER).alias("severity"))


@register("score_relevance", round_sql(oracle(f"""
SELECT doc_id, {d_relevance('event_category', 'severity_score', 't')} AS traffic_relevance_score FROM news_scored""", "news_scored"),
    ["traffic_relevance_score"]))
def q_score_relevance(spark, sf):
    t = N.full_text("title", "summary")
    c = classify_test(t)["category"]
    s = severity_test(c, t)
    return K.rounded(K.tables(spark, sf).news_raw.select("doc_id", relevance_test(c, s, t).alias("traffic_relevance_score")))


def d_city(text: str) -> tuple[str, str]:
    stripped = [(c, [_strip(a) for a in al]) for c, al in TEST_CITY_ALIASES.items()]
    hay = d_remove_accents(text)
    return d_first_rank(hay, stripped), d_first_kw(hay, stripped)


_CITY, _ALIAS = d_city("t")


@register("detect_city_text", oracle(f"""
SELECT doc_id, {_CITY} AS city, {_ALIAS} AS matched_alias FROM (SELECT doc_id, {d_clean_html(NEWS_TEXT)} AS t FROM news_raw) x""", "news_raw"))
def q_detect_city_text(spark, sf):
    c = N.detect_city_text(N.full_text("title", "summary"), None, TEST_CITY_ALIASES)
    return K.tables(spark, sf).news_raw.select("doc_id", c["city"].alias("city"), c["alias"].alias("matched_alias"))


@register("relevance_filter", oracle(f"""
SELECT doc_id FROM news_raw WHERE {d_any("lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, '')))", TEST_KEYWORDS)}""", "news_raw"))
def q_relevance_filter(spark, sf):
    return N.relevance_filter(K.tables(spark, sf).news_raw, TEST_KEYWORDS).select("doc_id")


@register("event_window_end", oracle(f"""
SELECT x.doc_id, x.event_category, n.published_at + to_hours(coalesce(h.hours, 3)) AS event_time_end
FROM (SELECT doc_id, {_CAT} AS event_category FROM (SELECT doc_id, {d_clean_html(NEWS_TEXT)} AS t FROM news_raw) c) x JOIN news_raw n USING (doc_id)
LEFT JOIN (VALUES {', '.join(f"({_lit(k)}, {v})" for k, v in N.EVENT_HOURS.items())}) h(category, hours) ON h.category = x.event_category""", "news_raw"))
def q_event_window_end(spark, sf):
    n = K.tables(spark, sf).news_raw
    c = classify_test(N.full_text("title", "summary"))["category"]
    d = n.select("doc_id", c.alias("event_category"), "published_at")
    return d.select("doc_id", "event_category", N.event_window_end(F.col("published_at"), F.col("event_category")).alias("event_time_end"))
