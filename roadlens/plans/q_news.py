"""Registered queries: Bronze news, normalised events, Silver events, page links,
locations, geocoding and snapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.traffic import CITY_CENTRES
from ..operators import news as N
from ..operators.components import materialize
from . import common as K
from .q_text import (NEWS_TEXT, TEST_ACTIVE, TEST_CITY_ALIASES, TEST_DAMPENING, TEST_DISTRICT, TEST_INFRA, TEST_KEYWORDS,
                     TEST_LADDER, TEST_PLANNED, TEST_PLANNING, TEST_PLANNING_LOW, TEST_ROAD, TEST_RULES, TEST_TYPE_RULES, _lit,
                     d_any, d_canonical_url, d_city, d_classify, d_clean_html, d_extract_first, d_first_rank, d_relevance,
                     d_remove_accents, d_severity, d_source_section, d_time_from_text, d_time_from_url, d_url_domain, _strip)
from .registry import oracle, register, round_sql, stage


def news_input(t):
    return t.news_raw.withColumn("ingest_order", F.col("doc_id"))


def bronze(t, *keep):
    return N.bronze_news(news_input(t), TEST_CITY_ALIASES, dict(TEST_RULES), keep=keep or None)


def _miss(c):
    return f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')"


_CITY_B, _ALIAS_B = d_city("ft")
_CATS = (f"CASE WHEN len(list_filter([{', '.join(f'CASE WHEN {d_any(d_remove_accents(chr(102) + chr(116)), [_strip(w) for w in words])} THEN {_lit(c)} END' for c, words in TEST_RULES)}], lambda x: x IS NOT NULL)) > 0 "
         f"THEN array_to_string(list_filter([{', '.join(f'CASE WHEN {d_any(d_remove_accents(chr(102) + chr(116)), [_strip(w) for w in words])} THEN {_lit(c)} END' for c, words in TEST_RULES)}], lambda x: x IS NOT NULL), ';') END")
_IMG = ("CASE WHEN regexp_extract(summary, '(?i)<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1) <> '' THEN "
        "regexp_extract(summary, '(?i)<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1) END")

stage("bronze_a", f"""
SELECT doc_id, doc_id AS ingest_order, external_id, source, provider, source_url, summary, published_at,
  sha1(concat_ws(chr(31), coalesce(source, ''), coalesce(external_id, ''), coalesce(source_url, ''), coalesce(title, ''), coalesce(summary, '')))
    AS record_id,
  {d_url_domain('source_url')} AS source_domain, {d_source_section('source')} AS source_section,
  CASE WHEN NOT {_miss('source_url')} THEN {d_canonical_url('source_url')} END AS canonical_url,
  CASE WHEN NOT {_miss('title')} THEN {d_clean_html('title')} END AS title_raw,
  CASE WHEN {d_clean_html('summary')} <> '' THEN {d_clean_html('summary')} END AS summary_text,
  {_IMG} AS image_url, {d_time_from_url('source_url')} AS url_t
FROM news_raw
""", "news_raw")

stage("bronze_b", f"""
SELECT *, CASE WHEN canonical_url IS NOT NULL AND canonical_url <> '' THEN sha256(canonical_url) END AS url_hash,
  sha256(concat(lower(coalesce(title_raw, '')), '|', lower(coalesce(summary_text, '')))) AS content_hash,
  coalesce(published_at, url_t) AS published_at_utc,
  CASE WHEN published_at IS NOT NULL THEN CASE WHEN provider = 'rss' THEN 'rss' ELSE 'html_meta' END
       WHEN url_t IS NOT NULL THEN 'url_timestamp' END AS published_at_source,
  CASE WHEN published_at IS NOT NULL THEN 'ok' WHEN url_t IS NOT NULL THEN 'parsed_from_url' ELSE 'missing' END AS published_at_parse_status,
  {_CITY_B} AS city_hint_raw, {_ALIAS_B} AS location_hint_raw, {_CATS} AS category_hint_raw
FROM (SELECT *, {d_clean_html("concat_ws(' ', coalesce(title_raw, ''), coalesce(summary_text, ''))")} AS ft FROM bronze_a) x
""", "bronze_a")

stage("bronze_c", f"""
SELECT *, list_sort(list_distinct(list_filter([
    CASE WHEN title_raw IS NULL THEN 'missing_title' END, CASE WHEN {_miss('summary')} THEN 'missing_summary' END,
    CASE WHEN coalesce(regexp_matches(summary, '<[^>]+>'), false) THEN 'summary_contains_html' END,
    CASE WHEN summary_text IS NULL THEN 'summary_text_empty' END, CASE WHEN image_url IS NOT NULL THEN 'image_extracted' END,
    CASE WHEN published_at IS NULL THEN 'missing_published_at' END,
    CASE WHEN published_at IS NULL AND url_t IS NOT NULL THEN 'published_at_from_url' END,
    CASE WHEN published_at IS NULL AND url_t IS NULL THEN 'parse_error' END,
    CASE WHEN city_hint_raw IS NULL THEN 'city_hint_missing' END, CASE WHEN category_hint_raw IS NULL THEN 'category_hint_missing' END,
    CASE WHEN list_contains(string_split(category_hint_raw, ';'), 'possible_unrelated') THEN 'possible_unrelated' END,
    CASE WHEN provider = 'html_listing' AND ({_miss('summary')} OR {_miss('published_at')}) THEN 'html_listing_partial' END
  ], lambda x: x IS NOT NULL))) AS flags0
FROM bronze_b
""", "bronze_b")


def _dup(key, i):
    return (f"CASE WHEN {key} IS NOT NULL AND ingest_order > min(ingest_order) OVER (PARTITION BY {key}) "
            f"THEN arg_min(record_id, ingest_order) OVER (PARTITION BY {key}) END")


stage("news_bronze", f"""
SELECT * EXCLUDE (flags0), duplicate_of_record_id IS NOT NULL AS is_exact_duplicate,
  CASE WHEN duplicate_of_record_id IS NOT NULL THEN list_sort(list_distinct(list_append(flags0, 'exact_duplicate'))) ELSE flags0 END
    AS data_quality_flags,
  CASE WHEN list_contains(flags0, 'html_listing_partial') THEN 'partial' ELSE 'ok' END AS fetch_status
FROM (SELECT *, coalesce({_dup('external_id', 0)}, {_dup('url_hash', 1)}, {_dup('content_hash', 2)}) AS duplicate_of_record_id
      FROM bronze_c) x
""", "bronze_c")

BRONZE_OUT = ["doc_id", "record_id", "source_domain", "source_section", "canonical_url", "url_hash", "content_hash", "title_raw",
              "summary_text", "image_url", "published_at_utc", "published_at_source", "published_at_parse_status", "city_hint_raw",
              "location_hint_raw", "category_hint_raw", "data_quality_flags", "fetch_status", "is_exact_duplicate",
              "duplicate_of_record_id"]


@register("bronze_news", oracle(f"SELECT {', '.join(BRONZE_OUT)} FROM news_bronze", "news_bronze"))
def q_bronze_news(spark, sf):
    return bronze(K.tables(spark, sf)).select(*BRONZE_OUT)


@register("mark_exact_duplicates", oracle(
    "SELECT doc_id, record_id, is_exact_duplicate, duplicate_of_record_id FROM news_bronze", "news_bronze"))
def q_mark_exact_duplicates(spark, sf):
    return bronze(K.tables(spark, sf), "doc_id", "record_id", "is_exact_duplicate", "duplicate_of_record_id")


@register("quality_flags", oracle("SELECT doc_id, data_quality_flags FROM news_bronze", "news_bronze"))
def q_quality_flags(spark, sf):
    return bronze(K.tables(spark, sf), "doc_id", "data_quality_flags")


@register("has_flag", oracle("""
SELECT doc_id, coalesce(list_contains(data_quality_flags, 'exact_duplicate'), false) AS is_dup_flag,
  coalesce(list_contains(data_quality_flags, 'missing_summary'), false) AS missing_summary FROM news_bronze""", "news_bronze"))
def q_has_flag(spark, sf):
    b = bronze(K.tables(spark, sf), "doc_id", "data_quality_flags")
    return b.select("doc_id", N.has_flag(F.col("data_quality_flags"), "exact_duplicate").alias("is_dup_flag"),
                    N.has_flag(F.col("data_quality_flags"), "missing_summary").alias("missing_summary"))


@register("explode_flags", oracle("SELECT flag, count(*) AS rows FROM (SELECT unnest(data_quality_flags) AS flag FROM news_bronze) x GROUP BY flag",
                                  "news_bronze"))
def q_explode_flags(spark, sf):
    return N.explode_flags(bronze(K.tables(spark, sf), "data_quality_flags"))


# ---------------------------------------------------------------- metric report
@register("metric_report", oracle("""
SELECT 'total_records' AS metric, CAST(count(*) AS VARCHAR) AS value FROM news_bronze
UNION ALL SELECT 'exact_duplicates', CAST(count(*) FILTER (WHERE is_exact_duplicate) AS VARCHAR) FROM news_bronze
UNION ALL SELECT 'missing_published_at_rate', CAST(floor(avg(CASE WHEN published_at IS NULL THEN 1e0 ELSE 0e0 END) * 1e4 + 5e-1) / 1e4 AS VARCHAR) FROM news_bronze
UNION ALL SELECT 'missing_summary_rate', CAST(floor(avg(CASE WHEN summary_text IS NULL THEN 1e0 ELSE 0e0 END) * 1e4 + 5e-1) / 1e4 AS VARCHAR) FROM news_bronze
UNION ALL SELECT concat('provider:', coalesce(provider, 'null')), CAST(count(*) AS VARCHAR) FROM news_bronze GROUP BY provider
UNION ALL SELECT concat('domain:', coalesce(source_domain, 'null')), CAST(count(*) AS VARCHAR) FROM news_bronze GROUP BY source_domain
UNION ALL SELECT concat('flag:', flag), CAST(count(*) AS VARCHAR) FROM (SELECT unnest(data_quality_flags) AS flag FROM news_bronze) f GROUP BY flag
UNION ALL SELECT concat('top_source:', source), CAST(n AS VARCHAR) FROM (
  SELECT source, count(*) AS n FROM news_bronze GROUP BY source ORDER BY n DESC, source LIMIT 10) s
""", "news_bronze"))
def q_metric_report(spark, sf):
    from ..operators.reports import metric_report

    # five consumers of one Bronze frame: materialise it once in the checkpoint folder
    b = bronze(K.tables(spark, sf)).select("provider", "source_domain", "source", "data_quality_flags", "is_exact_duplicate",
                                           "published_at", "summary_text").checkpoint(eager=True)
    return metric_report(b)


# ---------------------------------------------------------------- normalised events
def normalized(t, tasks: int | None = None):
    """``tasks``: the articles are spread over so many; the rules take long, and a file of many articles may be one task."""
    raw = news_input(t) if tasks is None else news_input(t).repartition(tasks)
    return N.normalize_events(raw, K.TEST_NOW, TEST_RULES, TEST_PLANNING, TEST_ACTIVE, TEST_INFRA, TEST_PLANNED,
                              TEST_LADDER, TEST_PLANNING_LOW, TEST_DAMPENING, TEST_CITY_ALIASES, TEST_DISTRICT, TEST_ROAD)


_CAT_N, _SUB_N = d_classify("ft")
_CITY_N, _ALIAS_N = d_city("ft")
_ROAD_N = f"CASE WHEN regexp_extract(ft, {_lit(TEST_ROAD)}, 1) <> '' THEN trim(regexp_replace(regexp_extract(ft, {_lit(TEST_ROAD)}, 1), '\\s+', ' ', 'g')) END"
_HOURS = "CASE " + " ".join(f"WHEN event_category = {_lit(k)} THEN {v}" for k, v in N.EVENT_HOURS.items()) + " ELSE 3 END"
_ACTIVE = ", ".join(_lit(c) for c in N.ACTIVE_CATEGORIES)

stage("events_a", f"""
SELECT doc_id, title, summary_text, published_at, source_url, ft,
  {d_time_from_url('source_url')} AS url_t, {d_time_from_text('ft', K.TEST_NOW)} AS text_t,
  {_CITY_N} AS city, {_ALIAS_N} AS alias, {d_extract_first('ft', TEST_DISTRICT)} AS district, {_ROAD_N} AS road_name,
  {_CAT_N} AS event_category, {_SUB_N} AS event_subtype
FROM (SELECT doc_id, {d_clean_html("coalesce(title, '')")} AS title, CASE WHEN summary IS NOT NULL THEN {d_clean_html('summary')} END AS summary_text,
        published_at, source_url,
        {d_clean_html(f"concat_ws(' ', coalesce({d_clean_html('coalesce(title, ' + chr(39) + chr(39) + ')')}, ''), coalesce(CASE WHEN summary IS NOT NULL THEN {d_clean_html('summary')} END, ''))")} AS ft
      FROM news_raw) r
""", "news_raw")

stage("events_n", f"""
SELECT *, {d_relevance('event_category', 'severity_score', 'ft')} AS traffic_relevance_score FROM (
SELECT *, coalesce(published_at, url_t, text_t, TIMESTAMP '{K.TEST_NOW}') AS event_time_start,
  CASE WHEN published_at IS NOT NULL THEN 'published_at' WHEN url_t IS NOT NULL THEN 'source_url'
       WHEN text_t IS NOT NULL THEN 'title_or_summary' ELSE 'fallback_now' END AS event_time_source,
  CASE WHEN published_at IS NOT NULL THEN 'high' WHEN url_t IS NOT NULL OR text_t IS NOT NULL THEN 'medium' ELSE 'low' END
    AS event_time_confidence,
  coalesce(road_name, district, alias) AS location_text,
  CASE WHEN road_name IS NOT NULL THEN 75e-2 WHEN district IS NOT NULL THEN 55e-2 WHEN city IS NOT NULL THEN 4e-1 ELSE 0e0 END AS geo_confidence,
  {d_severity('event_category', 'ft')} AS severity_score
FROM events_a) x
""", "events_a")

EVENT_OUT = ["doc_id", "title", "summary_text", "event_time_start", "event_time_source", "event_time_confidence", "city",
             "district", "road_name", "location_text", "geo_confidence", "event_category", "event_subtype", "severity_score",
             "traffic_relevance_score", "event_time_end", "has_accident", "has_roadwork", "has_flood",
             "is_relevant_for_traffic_model"]


@register("normalize_events", round_sql(oracle(f"""
SELECT doc_id, title, summary_text, event_time_start, event_time_source, event_time_confidence, city, district, road_name,
  location_text, geo_confidence, event_category, event_subtype, severity_score, traffic_relevance_score,
  event_time_start + to_hours({_HOURS}) AS event_time_end,
  CAST(event_category = 'accident' AS INTEGER) AS has_accident,
  CAST(event_category IN ('roadwork_active', 'roadwork_planned') AS INTEGER) AS has_roadwork,
  CAST(event_category = 'flood' AS INTEGER) AS has_flood,
  CAST(city IS NOT NULL AND event_category IN ({_ACTIVE}) AND traffic_relevance_score >= 55e-2 AS INTEGER) AS is_relevant_for_traffic_model
FROM events_n""", "events_n"), ["geo_confidence", "traffic_relevance_score"]))
def q_normalize_events(spark, sf):
    return K.rounded(normalized(K.tables(spark, sf)).select(*EVENT_OUT))


@register("resolve_event_time", oracle("SELECT doc_id, event_time_start, event_time_source, event_time_confidence FROM events_n", "events_n"))
def q_resolve_event_time(spark, sf):
    return normalized(K.tables(spark, sf)).select("doc_id", "event_time_start", "event_time_source", "event_time_confidence")


@register("keep_best_per_group", round_sql(oracle("""
SELECT event_category, arg_min(doc_id, struct_pack(r := -traffic_relevance_score, s := -severity_score, d := doc_id)) AS doc_id,
  max(traffic_relevance_score) AS traffic_relevance_score
FROM events_n GROUP BY event_category""", "events_n"), ["traffic_relevance_score"]))
def q_keep_best_per_group(spark, sf):
    from ..operators.news import keep_best_per_group

    e = normalized(K.tables(spark, sf)).select("doc_id", "event_category", "traffic_relevance_score", "severity_score")
    best = keep_best_per_group(e, "event_category", tiebreak="doc_id")
    return K.rounded(best.select("event_category", "doc_id", "traffic_relevance_score"))


_EVENT_FLAG = f"city IS NOT NULL AND event_category IN ({_ACTIVE}) AND traffic_relevance_score >= 55e-2"
stage("events_best", "SELECT DISTINCT ON (event_category, city, title) * FROM events_n ORDER BY event_category, city, title, traffic_relevance_score DESC, severity_score DESC, doc_id", "events_n")


@register("event_metric_report", oracle(f"""
SELECT 'raw_records' AS metric, count(*) AS value FROM news_raw
UNION ALL SELECT 'raw_missing_published_at', count(*) FILTER (WHERE published_at IS NULL) FROM news_raw
UNION ALL SELECT 'raw_missing_summary', count(*) FILTER (WHERE summary IS NULL OR trim(summary) IN ('', 'null', 'None', 'nan')) FROM news_raw
UNION ALL SELECT 'normalized_missing_city_after_detect', count(*) - count(city) FROM events_n
UNION ALL SELECT 'city_detected_or_retained', count(city) FROM events_n
UNION ALL SELECT 'unrelated_records', count(*) FILTER (WHERE event_category = 'unrelated') FROM events_n
UNION ALL SELECT 'model_eligible_records_before_dedup', count(*) FILTER (WHERE {_EVENT_FLAG}) FROM events_n
UNION ALL SELECT 'events_after_semantic_dedup', count(*) FROM events_best
UNION ALL SELECT 'model_eligible_events_after_dedup', count(*) FILTER (WHERE {_EVENT_FLAG}) FROM events_best
UNION ALL SELECT 'events_removed_by_semantic_dedup', (SELECT count(*) FROM events_n) - count(*) FROM events_best
UNION ALL SELECT concat('event_category.', event_category), count(*) FROM events_n GROUP BY event_category
UNION ALL SELECT concat('city.', coalesce(city, 'missing')), count(*) FROM events_n GROUP BY city
UNION ALL SELECT concat('severity_score.', CAST(severity_score AS VARCHAR)), count(*) FROM events_n GROUP BY severity_score
UNION ALL SELECT concat('event_time_confidence.', event_time_confidence), count(*) FROM events_n GROUP BY event_time_confidence""", "news_raw", "events_n", "events_best"))
def q_event_metric_report(spark, sf):
    """The event half of the report; here events of one category, city and title are one group, the best of which stays."""
    from ..operators.components import materialize
    from ..operators.reports import event_report

    t = K.tables(spark, sf)
    e = materialize(normalized(t).select("doc_id", "title", "city", "event_category", "severity_score", "traffic_relevance_score", "event_time_confidence", "is_relevant_for_traffic_model"))
    same = F.sha2(F.to_json(F.struct("event_category", "city", "title"), {"ignoreNullFields": "false"}), 256)
    best = N.keep_best_per_group(e.withColumn("same_event", same), "same_event", tiebreak="doc_id")
    return event_report(news_input(t), e, best)


# ---------------------------------------------------------------- pages -> links
_LINK_RE = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""

stage("links", f"""
SELECT page_id, link_pos, CASE
    WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h
    WHEN starts_with(h, '//') THEN concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), ':', h)
    WHEN starts_with(h, '/') THEN concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), h)
    ELSE concat(regexp_replace(regexp_extract(url, '^([^?#]*/)', 1), '/$', ''), '/', h) END AS link_url,
  {d_clean_html('txt')} AS link_text
FROM (SELECT page_id, url, trim(hrefs[i]) AS h, texts[i] AS txt, i - 1 AS link_pos FROM (
  SELECT page_id, url, regexp_extract_all(html, {_lit(_LINK_RE)}, 1) AS hrefs, regexp_extract_all(html, {_lit(_LINK_RE)}, 2) AS texts,
    generate_series(1, len(regexp_extract_all(html, {_lit(_LINK_RE)}, 1))) AS idx FROM pages) p, unnest(idx) AS u(i)) z
""")


@register("extract_links", oracle("SELECT * FROM links", "links"))
def q_extract_links(spark, sf):
    return N.extract_links(K.tables(spark, sf).pages)


# test listing pages are shallow: title >= 6 chars and depth >= 1 (production: 8 and 2)
TEST_LINK_KEYWORDS = ["the", "und", "les", "los", "and", "tion", "ich"]


@register("listing_link_filter", oracle(f"""
SELECT page_id, link_pos, link_url, link_text FROM (
  SELECT *, row_number() OVER (PARTITION BY link_url ORDER BY page_id, link_pos) AS rn FROM links
  WHERE length(link_text) >= 6
    AND (len(list_filter(string_split(regexp_extract(trim(link_url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) >= 1
         OR regexp_matches(regexp_extract(trim(link_url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\\d{{5,}}(\\.html?)?$'))
    AND {d_any("lower(concat_ws(' ', link_text, link_url))", TEST_LINK_KEYWORDS)}) x WHERE rn = 1""", "links"))
def q_listing_link_filter(spark, sf):
    links = N.extract_links(K.tables(spark, sf).pages)
    return N.listing_link_filter(links, TEST_LINK_KEYWORDS, min_title=6, min_depth=1).select("page_id", "link_pos", "link_url", "link_text")


# ---------------------------------------------------------------- locations, geocode, snap
@register("extract_locations", oracle("""
SELECT doc_id, CASE WHEN city IS NOT NULL AND NOT list_contains(found, city) THEN list_append(found, city) ELSE found END AS locations
FROM (SELECT e.doc_id, e.city, list_filter(list_transform(g.names, lambda n: n.name), lambda n: contains(lower(e.ft), n)) AS found
      FROM events_a e, (SELECT list(struct_pack(name := lower(name)) ORDER BY length(name) DESC, lower(name)) AS names FROM gazetteer) g) x
""", "events_a", "gazetteer"))
def q_extract_locations(spark, sf):
    t = K.tables(spark, sf)
    e = materialize(normalized(t).select("doc_id", "full_text", "city"))
    return N.extract_locations(e, "full_text", t.gazetteer, "city").select("doc_id", "locations")


def _centre_sql(col):
    return "CASE " + " ".join(f"WHEN {col} = {_lit(c)} THEN {v}" for c, v in
                              [(k, f"[{la}e0, {lo}e0]") for k, (la, lo) in CITY_CENTRES.items()]) + " END"


@register("geocode_join", round_sql(oracle(f"""
SELECT doc_id, location_entity, coalesce(g.lat, ({_centre_sql('e.city')})[1]) AS lat, coalesce(g.lon, ({_centre_sql('e.city')})[2]) AS lon,
  CASE WHEN g.lat IS NOT NULL THEN 'ok' WHEN e.city IN ('hanoi', 'hcmc') THEN 'city_fallback' ELSE 'failed' END AS geocode_status
FROM (SELECT doc_id, city, CASE WHEN doc_id % 3 = 0 THEN (SELECT min(name) FROM gazetteer WHERE CAST(length(name) AS BIGINT) % 25 = doc_id % 25)
        ELSE district END AS location_entity FROM events_n) e
LEFT JOIN gazetteer g ON lower(e.location_entity) = lower(g.name)""", "events_n", "gazetteer"), ["lat", "lon"]))
def q_geocode_join(spark, sf):
    t = K.tables(spark, sf)
    gz = t.gazetteer
    names = gz.groupBy((F.length("name").cast("bigint") % 25).alias("_k")).agg(F.min("name").alias("_n"))
    e = normalized(t).select("doc_id", "city", "district")
    e = e.join(F.broadcast(names), (F.col("doc_id") % 25) == F.col("_k"), "left")
    e = e.withColumn("location_entity", F.when(F.col("doc_id") % 3 == 0, F.col("_n")).otherwise(F.col("district"))).drop("_k", "_n", "district")
    g = N.geocode_join(e, gz, "location_entity", "city")
    return K.rounded(g.select("doc_id", "location_entity", "lat", "lon", "geocode_status"))


@register("snap_confidence", round_sql(oracle("""
SELECT event_id, least(
  CASE WHEN d IS NULL THEN 3e-1 WHEN d < 50 THEN 1e0 WHEN d < 200 THEN 7e-1 ELSE 4e-1 END
  + CASE WHEN contains(lower(coalesce(loc, '')), 'cầu ') OR contains(lower(coalesce(loc, '')), 'nút giao') THEN 15e-2
         WHEN contains(lower(coalesce(loc, '')), 'đường ') THEN 5e-2 ELSE 0e0 END
  + least(m * 5e-2, 15e-2), 1e0) AS event_confidence
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 400 AS DOUBLE) END AS d,
        CASE event_id % 3 WHEN 0 THEN 'cầu Long Biên' WHEN 1 THEN 'đường Láng' ELSE 'khu vực' END AS loc,
        CAST(event_id % 5 AS BIGINT) AS m FROM incident_obs) x""", "incident_obs"), ["event_confidence"]))
def q_snap_confidence(spark, sf):
    i = K.tables(spark, sf).incident_obs
    d = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise((F.col("event_id") % 400).cast("double"))
    loc = F.when(F.col("event_id") % 3 == 0, "cầu Long Biên").when(F.col("event_id") % 3 == 1, "đường Láng").otherwise("khu vực")
    out = i.select("event_id", N.snap_confidence(d, loc, (F.col("event_id") % 5)).alias("event_confidence"))
    return K.rounded(out)


@register("snap_to_segment", round_sql(oracle("""
SELECT name, s.seg AS snapped_segment_id, s.d AS snap_distance_m FROM (
  SELECT g.name, arg_min(struct_pack(seg := x.segment_id, d := d.dm), struct_pack(d := d.dm, seg := x.segment_id))
    FILTER (WHERE x.segment_id IS NOT NULL) AS s
  FROM gazetteer g CROSS JOIN (SELECT segment_id, lat AS slat, lon AS slon FROM latest) x
  CROSS JOIN LATERAL (SELECT 2 * 6371e0 * asin(sqrt(pow(sin((radians(x.slat) - radians(g.lat)) / 2), 2)
      + cos(radians(g.lat)) * cos(radians(x.slat)) * pow(sin((radians(x.slon) - radians(g.lon)) / 2), 2))) * 1000e0 AS dm) d
  GROUP BY g.name) y""", "gazetteer", "latest"), ["snap_distance_m"]))
def q_snap_to_segment(spark, sf):
    t = K.tables(spark, sf)
    segs = K.latest(t).select("segment_id", "lat", "lon")
    out = N.snap_to_segment(t.gazetteer.select("name", "lat", "lon"), segs, 0.01)
    return K.rounded(out.select("name", "snapped_segment_id", "snap_distance_m"))


@register("silver_events", oracle(f"""
SELECT source_url, event_type, location_entity FROM (
  SELECT *, CASE WHEN city IS NOT NULL AND NOT list_contains(found, city) THEN list_append(found, city) ELSE found END AS locs FROM (
    SELECT n.source_url, n.city, coalesce({d_first_rank("lower(concat_ws(' ', coalesce(n.title, ''), coalesce(n.summary, '')))", TEST_TYPE_RULES)}, 'other') AS event_type,
      list_filter(list_transform(g.names, lambda n: n.name), lambda nm: contains(lower(concat_ws(' ', coalesce(n.title, ''), coalesce(n.summary, ''))), nm)) AS found
    FROM (SELECT * FROM (SELECT r.*, e.city, row_number() OVER (PARTITION BY r.source_url ORDER BY r.doc_id) AS rn
                         FROM news_raw r JOIN events_a e USING (doc_id)) q WHERE rn = 1) n,
         (SELECT list(struct_pack(name := lower(name)) ORDER BY length(name) DESC, lower(name)) AS names FROM gazetteer) g) a) b
  CROSS JOIN LATERAL (SELECT locs[1] AS location_entity) c""", "news_raw", "events_a", "gazetteer"))
def q_silver_events(spark, sf):
    t = K.tables(spark, sf)
    ev = normalized(t).select("doc_id", "city")
    raw = news_input(t).join(ev, "doc_id").withColumn("record_id", F.col("doc_id").cast("string"))
    s = N.silver_events(materialize(raw), TEST_TYPE_RULES, t.gazetteer)
    return s.select("source_url", "event_type", "location_entity")
