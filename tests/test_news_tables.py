"""Default rule tables and the whole HTML unescape."""

import html

import pytest
from pyspark.sql import functions as F

from roadlens.functions import text as X
from roadlens.operators import news as N


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text", [
    "V&agrave;i &#8217;x&#8217; &ldquo;a&rdquo; &#x1F600; &lt;b&gt; &amp;lt; &unknown; & &;", "no entity", "&amp;&amp;", "&#0; &#xD800; &copy;2024 &middot;",
])
def test_unescape_matches_the_standard_library(spark, text):
    got = one(spark, text, X.unescape)
    if "&#0;" in text:  # characters that no text may hold stay as written
        assert got == "&#0; &#xD800; ©2024 ·"
    else:
        assert got == html.unescape(text)


def test_unescape_null_and_spaces(spark):
    assert one(spark, None, X.unescape) is None
    assert one(spark, "a&nbsp;b", X.unescape) == "a b"


@pytest.mark.parametrize("text,city", [("Ùn tắc ở Hải Phòng", "haiphong"), ("un tac tai hai phong", "haiphong"), ("Sập cầu ở Cần Thơ", "cantho"), ("gần Nội Bài", "hanoi"),
                                       ("đường Bùi Viện", "hcmc"), ("Buôn Ma Thuột mưa", "daklak"), ("không rõ nơi nào", None), ("Châu Đốc", "angiang")])
def test_default_city_table(spark, text, city):
    assert one(spark, text, lambda t: N.detect_city_text(t, None)["city"]) == city


def test_city_table_is_whole():
    assert len(N.CITY_ALIASES) == 27


@pytest.mark.parametrize("text,want", [("va chạm tại quận 1", "quận 1"), ("ở thành phố thủ đức", "thành phố thủ đức"), ("không có", None)])
def test_default_district_patterns(spark, text, want):
    assert one(spark, text, lambda t: N.extract_first(t, N.DISTRICT_PATTERNS)) == want


@pytest.mark.parametrize("text,want", [("Tai nạn trên đại lộ Thăng Long.", "đại lộ Thăng Long."), ("kẹt ở nút giao An Phú", "nút giao An Phú"), ("hầm 2 đóng", "hầm 2 đóng")])
def test_default_road_pattern(spark, text, want):
    assert one(spark, text, lambda t: N.extract_first(t, [N.ROAD_PATTERN], lower=False)) == want


def test_default_categories_types_severity_and_keywords(spark):
    assert one(spark, "Ngân hàng tăng lãi, tai nạn giảm", N.detect_categories) == "accident;possible_unrelated"
    assert one(spark, "Thi công và tai nạn", N.classify_event_type) == "accident"
    assert one(spark, "Áp thấp nhiệt đới", N.classify_event_type) == "weather"
    assert one(spark, "trời đẹp", N.classify_event_type) == "other"
    assert [one(spark, t, N.score_severity_keywords) for t in ("hai người tử vong", "kẹt xe dài", "lưu thông chậm", "bình thường")] == [3, 2, 1, 0]
    rows = spark.createDataFrame([(1, "Kẹt xe sáng nay", None), (2, "Giá vàng", "hôm nay")], "id int, title string, summary string")
    assert [r.id for r in N.relevance_filter(rows).collect()] == [1]


def test_bronze_flags_unrelated_articles(spark):
    raw = spark.sql("SELECT 's' AS source, 'e' AS external_id, 'rss' AS provider, 'Ngân hàng mở cửa' AS title, 'tài chính' AS summary, "
                    "'https://a.vn/x/y.html' AS source_url, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS published_at, 1 AS ingest_order")
    assert "possible_unrelated" in N.bronze_news(raw).first().data_quality_flags


def test_bronze_cleans_texts_once_and_marks_duplicates(spark):
    rows = [(i, f"e{i}", "s_giao_thong", "rss", f"t{i % 3}", f"<b>body</b> {i % 3}", f"http://h/x{i}", None) for i in range(6)] + [(None, None, None, None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "ingest_order long, external_id string, source string, provider string, title string, summary string, source_url string, published_at timestamp_ntz")
    df = N.bronze_news(raw, {}, {"k": ["body"]})
    got = {r.ingest_order: r for r in df.collect()}
    record = {i: r.record_id for i, r in got.items()}
    assert {i: r.duplicate_of_record_id for i, r in got.items()} == {0: None, 1: None, 2: None, 3: record[0], 4: record[1], 5: record[2], None: None}
    assert all(("exact_duplicate" in r.data_quality_flags) == r.is_exact_duplicate == (i in (3, 4, 5)) for i, r in got.items())
    assert {r.summary_raw for r in got.values()} == {None, "<b>body</b> 0", "<b>body</b> 1", "<b>body</b> 2"} and got[1].category_hint_raw == "k"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "sha2" not in plan  # four branches read what was cleaned once
