"""News articles -> located, classified, scored events (no row-wise Python).

Rule sets (keywords, aliases, patterns) are arguments. Defaults are the production
Vietnamese tables; tests pass rule tables that fit the driver's prose.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.timefn import col_
from ..functions.traffic import CITY_CENTRES, EARTH_RADIUS_KM, haversine_km
from .components import materialize

# Production rule tables.
CATEGORY_RULES = [
    ("accident", ["tai nạn", "va chạm", "tông", "đâm", "lật xe", "bị cán", "tử vong", "bị thương"]),
    ("congestion", ["ùn tắc", "ùn ứ", "kẹt xe", "tắc đường", "tắc kéo dài", "ách tắc"]),
    ("flood", ["ngập", "ngập úng", "ngập lụt", "nước dâng"]),
    ("weather_disruption", ["mưa lớn", "mưa rất to", "bão", "gió mạnh", "sạt lở", "trơn trượt", "sương mù"]),
    ("roadwork_active", ["thi công", "rào chắn", "phân luồng", "cấm đường", "đóng đường", "sửa đường"]),
    ("airport", ["sân bay", "đường băng", "chuyến bay", "hạ cánh", "cảng hàng không"]),
    ("public_transport", ["xe buýt", "buýt", "metro", "đường sắt đô thị", "tàu điện", "bến xe"]),
    ("enforcement", ["csgt", "xử phạt", "nồng độ cồn", "tước gplx", "camera phạt nguội", "đăng kiểm"]),
    ("planned_event", ["lễ hội", "concert", "sự kiện", "diễu hành", "chạy marathon", "cấm đường phục vụ"]),
    ("roadwork_planned", ["sắp thi công", "sẽ phân luồng", "chuẩn bị rào chắn", "dự kiến thi công"]),
    ("infrastructure_planning", ["quy hoạch", "đề xuất", "sắp mở rộng", "dự án", "đầu tư", "khởi công", "thẩm định", "thi tuyển kiến trúc"]),
]
PLANNING_TERMS = ["quy hoạch", "đề xuất", "sắp mở rộng", "dự án", "đầu tư", "khởi công", "thẩm định",
                  "thi tuyển kiến trúc", "dự kiến", "chuẩn bị", "sắp thông xe", "sắp về đích"]
ACTIVE_ROADWORK_TERMS = ["đang thi công", "thi công", "phân luồng", "cấm đường", "hạn chế phương tiện", "rào chắn",
                         "đóng đường", "sửa đường", "sửa cầu", "lộ trình thay thế", "cải tạo"]
INFRA_TERMS = ["đường", "cầu", "cao tốc", "quốc lộ", "vành đai", "hạ tầng", "nút giao"]
PLANNED_ROADWORK_TERMS = ["sắp thi công", "dự kiến thi công", "chuẩn bị rào chắn"]
SEVERITY_LADDER = {
    5: ["tử vong", "chết", "nhiều người bị thương", "19 người bị thương", "thiệt mạng"],
    4: ["ùn tắc kéo dài", "va chạm liên hoàn", "mưa rất to", "ngập úng", "ngập sâu", "sạt lở"],
    3: ["tai nạn", "va chạm", "thi công", "phân luồng", "trơn trượt", "cấm đường"],
}
PLANNING_LOW_TERMS = ["đề xuất", "quy hoạch", "sắp mở rộng"]
RELEVANCE_BASE = {
    "accident": 0.95, "congestion": 0.95, "flood": 0.9, "weather_disruption": 0.85, "roadwork_active": 0.85,
    "airport": 0.65, "public_transport": 0.6, "enforcement": 0.55, "planned_event": 0.55,
    "roadwork_planned": 0.35, "infrastructure_planning": 0.25, "unrelated": 0.0,
}
DAMPENING_TERMS = ["tài chính", "ngân hàng", "thi tuyển kiến trúc", "đề xuất"]
# Matching drops accents on both sides, so accentless spellings need no entry of their own.
CITY_ALIASES = {
    "hanoi": ["hà nội", "nguyễn chí thanh", "la thành", "nguyễn chánh", "thủ đô", "nội bài", "vành đai 3", "hoàn kiếm",
              "mỹ đình", "thường tín", "pháp vân", "cầu giẽ", "nguyễn văn huyên", "nguyễn xuân linh"],
    "hcmc": ["tp.hcm", "tp hcm", "tphcm", "hồ chí minh", "sài gòn", "thủ thiêm", "cầu sài gòn", "tân sơn nhất", "quận 1",
             "bến thành", "cộng hòa", "hàng xanh", "cầu phú mỹ", "cầu bình lợi", "điện biên phủ", "nguyễn duy trinh",
             "an khánh", "sala", "bùi viện"],
    "danang": ["đà nẵng"],
    "haiphong": ["hải phòng", "cát bi"],
    "cantho": ["cần thơ"],
    "hue": ["huế", "phú bài"],
    "dongnai": ["đồng nai", "long thành", "dầu giây", "quốc lộ 51"],
    "lamdong": ["lâm đồng", "đà lạt", "đạ huoai"],
    "hatinh": ["hà tĩnh", "bãi vọt", "hàm nghi"],
    "quangninh": ["quảng ninh", "hạ long", "móng cái", "cẩm phả"],
    "hungyen": ["hưng yên", "nguyễn văn linh"],
    "ninhbinh": ["ninh bình", "hoa lư"],
    "quangtri": ["quảng trị", "cam lộ", "la sơn", "đông hà"],
    "khanhhoa": ["khánh hòa", "nha trang"],
    "tayninh": ["tây ninh"],
    "daklak": ["đắk lắk", "đăk lăk", "daklak", "buôn ma thuột"],
    "gialai": ["gia lai", "an khê", "tô na"],
    "laocai": ["lào cai"],
    "bacninh": ["bắc ninh"],
    "nghean": ["nghệ an"],
    "thanhhoa": ["thanh hóa"],
    "quangngai": ["quảng ngãi"],
    "vungtau": ["vũng tàu", "bà rịa"],
    "binhduong": ["bình dương", "thủ dầu một"],
    "camau": ["cà mau"],
    "angiang": ["an giang", "núi sam", "châu đốc"],
    "dongthap": ["đồng tháp"],
}
DISTRICT_PATTERNS = [r"\bquận\s+[0-9a-zà-ỹ]+", r"\bhuyện\s+[a-zà-ỹ\s]{2,25}", r"\bthành phố\s+[a-zà-ỹ\s]{2,25}",
                     r"\btp\.?\s*[a-zà-ỹ\s]{2,25}"]
ROAD_WORDS = ["đường", "phố", "cầu", "cao tốc", "quốc lộ", "tỉnh lộ", "đại lộ", "vành đai", "nút giao", "hầm", "sân bay", "ga"]
ROAD_NAME = r"[A-ZÀ-Ỹ0-9][A-Za-zÀ-ỹ0-9.\-/]*"
ROAD_PATTERN = rf"(?iu)(?U)\b((?:{'|'.join(ROAD_WORDS)})\s+{ROAD_NAME}(?:\s+{ROAD_NAME}){{0,6}})"
# Categories of Bronze evidence (a hit of the last one flags the article).
EVIDENCE_CATEGORIES = {
    "accident": ["tai nạn", "va chạm", "tông", "đâm", "cán", "tử vong", "bị thương", "liên hoàn"],
    "congestion": ["ùn tắc", "kẹt xe", "ùn ứ"],
    "roadwork": ["thi công", "phân luồng", "sửa đường", "mở rộng", "sửa cầu", "xuống cấp"],
    "weather": ["mưa lớn", "ngập úng", "trơn trượt", "không khí lạnh", "ngập sâu", "giông", "sạt lở"],
    "airport": ["sân bay", "đường băng", "cảng hàng không"],
    "enforcement": ["csgt", "xử phạt", "nồng độ cồn", "gplx"],
    "public_transport": ["xe buýt", "buýt", "metro", "đường sắt", "tàu hỏa"],
    "planned_event": ["diễn đàn", "lễ hội", "hội báo", "đại biểu"],
    "possible_unrelated": ["ngân hàng", "tài chính", "sim", "thuê bao", "trái cây", "lễ phục"],
}
# Event types of the lakehouse path, in order of priority.
EVENT_TYPE_RULES = [
    ("accident", ["tai nạn", "va chạm", "lật xe", "đâm vào", "đụng nhau", "tai nạn giao thông", "xe máy đâm", "ôtô đâm", "xe tải đâm",
                  "húc vào", "tông vào", "tông nhau", "lao vào"]),
    ("flood", ["ngập", "ngập lụt", "ngập sâu", "mưa lớn gây ngập", "nước ngập", "ngập úng", "triều cường ngập"]),
    ("event", ["lễ hội", "hội chợ", "sự kiện", "biểu diễn", "countdown", "lễ kỷ niệm", "đại hội", "marathon", "giải chạy",
               "chương trình biểu diễn", "lễ khai mạc"]),
    ("road_work", ["sửa đường", "thi công", "rào chắn", "cấm đường", "phân luồng", "nâng cấp đường", "mở rộng đường", "xây dựng cầu",
                   "thi công hầm", "cải tạo đường", "đào đường", "láng nhựa"]),
    ("weather", ["bão", "gió mạnh", "sương mù dày", "mưa lớn", "mưa đá", "lũ lụt", "lốc xoáy", "áp thấp nhiệt đới"]),
]
# Severity 0..3 of the lakehouse path.
KEYWORD_SEVERITY = {
    3: ["chết người", "tử vong", "thiệt mạng", "nguy kịch", "tắc nghiêm trọng", "kẹt nhiều giờ", "tê liệt giao thông",
        "ùn tắc nghiêm trọng", "ách tắc toàn tuyến"],
    2: ["ùn tắc kéo dài", "phương tiện dồn ứ", "ngập sâu", "kẹt xe dài", "ùn ứ kéo dài", "tắc đường dài", "ùn tắc hàng km",
        "cấm đường hoàn toàn"],
    1: ["ùn ứ cục bộ", "lưu thông chậm", "di chuyển khó khăn", "lưu thông ảnh hưởng", "ùn nhẹ", "chậm lại", "phân luồng",
        "cấm một chiều"],
}
# Words that make a feed entry worth fetching.
TRAFFIC_KEYWORDS = [
    "tai nạn", "va chạm", "lật xe", "đâm vào", "đụng nhau", "ngập", "ngập lụt", "ngập sâu", "mưa lớn", "sửa đường", "thi công",
    "rào chắn", "cấm đường", "phân luồng", "ùn tắc", "ùn ứ", "kẹt xe", "tắc đường", "tắc nghiêm trọng", "lễ hội", "hội chợ",
    "sự kiện", "biểu diễn", "bão", "gió mạnh", "sương mù", "tai nạn giao thông", "ách tắc",
]
EVENT_HOURS = {"roadwork_active": 24, "roadwork_planned": 24, "infrastructure_planning": 24,
               "flood": 6, "weather_disruption": 6, "planned_event": 6}
ACTIVE_CATEGORIES = ("accident", "congestion", "flood", "weather_disruption", "roadwork_active", "airport",
                     "public_transport", "enforcement", "planned_event")


def _joined(title: str, summary: str) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(summary), F.lit("")))


def full_text(title: str = "title", summary: str = "summary_text") -> Column:
    return X.clean_html(_joined(title, summary))


# ---------------------------------------------------------------- filters
def relevance_filter(df: DataFrame, keywords: Sequence[str] = TRAFFIC_KEYWORDS, cols: Sequence[str] = ("title", "summary")) -> DataFrame:
    """Keep articles whose lower-cased title + summary contains any keyword."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    return df.filter(X.any_keyword(text, keywords))


def classify_event(text: Column, rules=CATEGORY_RULES, planning=PLANNING_TERMS, active=ACTIVE_ROADWORK_TERMS,
                   infra=INFRA_TERMS, planned_roadwork=PLANNED_ROADWORK_TERMS) -> Column:
    """Ordered rules with planning/active-roadwork precedence -> struct(category, subtype)."""
    low = F.lower(text)
    act = X.first_keyword(low, {"a": active})
    plan = X.first_keyword(low, {"p": planning})
    planning_case = plan.isNotNull() & act.isNull() & X.any_keyword(low, infra)
    planning_cat = F.when(X.any_keyword(low, planned_roadwork), F.lit("roadwork_planned")).otherwise(F.lit("infrastructure_planning"))
    ordered_active = [("roadwork_active", list(active))] + [r for r in rules if r[0] != "roadwork_active"]
    rules_d = dict(rules)
    normal = F.struct(F.coalesce(X.first_alias_rank(low, rules_d), F.lit("unrelated")).alias("category"),
                      F.coalesce(X.first_keyword(low, rules_d), F.lit("unrelated")).alias("subtype"))
    act_d = dict(ordered_active)
    with_active = F.struct(F.coalesce(X.first_alias_rank(low, act_d), F.lit("unrelated")).alias("category"),
                           F.coalesce(X.first_keyword(low, act_d), F.lit("unrelated")).alias("subtype"))
    return (F.when(planning_case, F.struct(planning_cat.alias("category"), plan.alias("subtype")))
            .when(act.isNotNull(), with_active).otherwise(normal))


def classify_event_type(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = EVENT_TYPE_RULES, default: str = "other") -> Column:
    """Priority-ordered rule classifier (first matching type wins)."""
    return F.coalesce(X.first_alias_rank(F.lower(text), dict(rules)), F.lit(default))


def detect_categories(text: Column, rules: dict[str, Sequence[str]] = EVIDENCE_CATEGORIES, plain: Column | None = None) -> Column:
    """All matching categories (accent-insensitive), ';'-joined, null when none.  ``plain``: a column that holds the text without accents;
    an expression in its place is computed anew for every keyword."""
    hay = X.remove_accents(text) if plain is None else plain
    hits = F.array_compact(F.array(*[F.when(X.any_keyword(hay, [_strip(w) for w in words]), F.lit(cat)) for cat, words in rules.items()]))
    return F.when(F.size(hits) > 0, F.array_join(hits, ";"))


def _strip(word: str) -> str:
    import unicodedata
    w = unicodedata.normalize("NFD", word.lower())
    return "".join(ch for ch in w if unicodedata.category(ch) != "Mn").replace("đ", "d")


def score_severity(category: Column, text: Column, ladder=SEVERITY_LADDER, planning_low=PLANNING_LOW_TERMS) -> Column:
    """0..5 scale with category (verified path)."""
    low = F.lower(text)
    expr = F.when(category == "unrelated", F.lit(0))
    for level in sorted(ladder, reverse=True):
        expr = expr.when(X.any_keyword(low, ladder[level]), F.lit(level))
    expr = expr.when(category.isin("infrastructure_planning", "roadwork_planned"),
                     F.when(X.any_keyword(low, planning_low), F.lit(1)).otherwise(F.lit(2)))
    return expr.otherwise(F.lit(2))


def score_severity_keywords(text: Column, ladder: dict[int, Sequence[str]] = KEYWORD_SEVERITY) -> Column:
    """0..3 keyword ladder (lakehouse path): highest level with a hit, else 0."""
    low = F.lower(text)
    expr = None
    for level in sorted(ladder, reverse=True):
        cond = X.any_keyword(low, ladder[level])
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit(0)) if expr is not None else F.lit(0)


def score_relevance(category: Column, severity: Column, text: Column, base=RELEVANCE_BASE, dampening=DAMPENING_TERMS) -> Column:
    b = F.coalesce(F.element_at(F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(float(v)))]), category), F.lit(0.0))
    b = b + F.when(severity >= 4, F.lit(0.05)).otherwise(F.lit(0.0))
    b = b - F.when(X.any_keyword(F.lower(text), dampening), F.lit(0.1)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), b))


def detect_city_text(text: Column, hint: Column | None, aliases=CITY_ALIASES, plain: Column | None = None) -> Column:
    """struct(city, alias): hint first, then text; first alias in city order; accent-insensitive.  ``plain``: as in ``detect_categories``."""
    stripped = {c: [_strip(a) for a in al] for c, al in aliases.items()}
    hay = X.remove_accents(text) if plain is None else plain
    found = X.first_match(hay, stripped)
    from_text = F.struct(found["name"].alias("city"), found["keyword"].alias("alias"))
    if hint is None:
        return from_text
    h = X.remove_accents(hint)
    hint_ok = hint.isNotNull() & ~F.lower(F.trim(hint)).isin("nan", "none", "")
    from_hint = F.struct(X.first_alias_rank(h, stripped).alias("city"), hint.alias("alias"))
    return F.when(hint_ok & from_hint["city"].isNotNull(), from_hint).otherwise(from_text)


def extract_first(text: Column, patterns: Sequence[str], lower: bool = True) -> Column:
    """First regex match over the patterns in order, whitespace-normalised; null when none."""
    t = F.lower(text) if lower else text
    out = None
    for p in patterns:
        m = F.regexp_extract(t, p, 0)
        v = F.when(m != "", F.trim(F.regexp_replace(m, r"\s+", " ")))
        out = v if out is None else F.coalesce(out, v)
    return out


def event_window_end(start: Column, category: Column, hours=EVENT_HOURS, default: int = 3) -> Column:
    h = F.coalesce(F.element_at(F.create_map(*[x for k, v in hours.items() for x in (F.lit(k), F.lit(v))]), category), F.lit(default))
    return start + F.make_dt_interval(F.lit(0), h.cast("int"))


def bronze_news(raw: DataFrame, city_aliases=CITY_ALIASES, category_rules: dict | None = None,
                order: str = "ingest_order", keep: Sequence[str] | None = None) -> DataFrame:
    """Raw article rows -> Bronze evidence rows: record id, domain/section, canonical URL and
    hashes, cleaned summary and image, resolved publish time with source/status, city and
    category hints, sorted quality flags, then exact-duplicate marking in ingest order.  ``keep``: the
    columns to return, all by default; of the others only those that the search for duplicates reads are stored."""
    category_rules = category_rules if category_rules is not None else EVIDENCE_CATEGORIES
    miss = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    title = F.when(~miss("title"), X.clean_html(F.col("title")))
    # what several rules read is a column of its own: an expression would be computed anew by each
    summary_text = F.when(F.col("_clean_summary") != "", F.col("_clean_summary"))
    df = raw.withColumn("_clean_summary", X.clean_html(F.col("summary"))).withColumns({
        "record_id": F.sha1(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                                                   ("source", "external_id", "source_url", "title", "summary")])),
        "source_domain": X.url_domain("source_url"),
        "source_section": X.source_section("source"),
        "canonical_url": F.when(~miss("source_url"), X.canonical_url("source_url")),
        "title_raw": title,
        "summary_raw": F.col("summary"),
        "summary_text": summary_text,
        "image_url": X.extract_image_url("summary"),
    }).drop("_clean_summary")
    df = df.withColumns({
        "url_hash": X.sha256_or_null("canonical_url"),
        "content_hash": F.sha2(F.concat(F.lower(F.coalesce(F.col("title_raw"), F.lit(""))), F.lit("|"),
                                        F.lower(F.coalesce(F.col("summary_text"), F.lit("")))), 256),
    })
    pub = X.parse_utc(F.col("published_at"))
    url_t = X.time_from_url("source_url")
    ing = X.parse_utc(F.col("ingestion_time")) if "ingestion_time" in raw.columns else F.lit(None).cast("timestamp_ntz")
    df = df.withColumns({
        "published_at_utc": F.coalesce(pub, url_t, ing),
        "published_at_source": F.when(pub.isNotNull(), F.when(F.col("provider") == "rss", "rss").otherwise("html_meta"))
        .when(url_t.isNotNull(), "url_timestamp").when(ing.isNotNull(), "ingestion_time_fallback"),
        "published_at_parse_status": F.when(pub.isNotNull(), "ok").when(url_t.isNotNull(), "parsed_from_url")
        .when(ing.isNotNull(), "fallback_low_confidence").otherwise("missing"),
    })
    # both parts are clean: their white space is single spaces already
    df = df.withColumn("_joined", _joined("title_raw", "summary_text"))
    df = df.withColumn("_full_text", F.when(X.has_markup(F.col("_joined")), X.clean_html("_joined")).otherwise(F.trim("_joined"))).drop("_joined")
    df = df.withColumn("_lower", F.lower("_full_text")).withColumn("_plain", X.remove_accents_lower("_lower")).drop("_lower")
    text, plain = F.col("_full_text"), F.col("_plain")
    hint = F.col("city_hint") if "city_hint" in raw.columns else None
    df = df.withColumn("_city", detect_city_text(text, hint, city_aliases, plain))
    df = df.withColumns({"city_hint_raw": F.col("_city.city"), "location_hint_raw": F.col("_city.alias"),
                         "category_hint_raw": detect_categories(text, category_rules, plain)}).drop("_full_text", "_plain", "_city")
    flags = F.array(
        F.when(F.col("title_raw").isNull(), F.lit("missing_title")),
        F.when(miss("summary"), F.lit("missing_summary")),
        F.when(F.coalesce(X.has_html("summary"), F.lit(False)), F.lit("summary_contains_html")),
        F.when(F.col("summary_text").isNull(), F.lit("summary_text_empty")),
        F.when(F.col("image_url").isNotNull(), F.lit("image_extracted")),
        F.when(pub.isNull(), F.lit("missing_published_at")),
        F.when(pub.isNull() & url_t.isNotNull(), F.lit("published_at_from_url")),
        F.when(pub.isNull() & url_t.isNull() & ing.isNotNull(), F.lit("published_at_fallback_ingestion_time")),
        F.when(pub.isNull() & url_t.isNull() & ing.isNull(), F.lit("parse_error")),
        F.when(F.col("city_hint_raw").isNull(), F.lit("city_hint_missing")),
        F.when(F.col("category_hint_raw").isNull(), F.lit("category_hint_missing")),
        F.when(F.array_contains(F.split(F.col("category_hint_raw"), ";"), "possible_unrelated"), F.lit("possible_unrelated")),
        F.when((F.col("provider") == "html_listing") & (miss("summary") | miss("published_at")), F.lit("html_listing_partial")),
    )
    df = df.withColumn("data_quality_flags", F.array_sort(F.array_distinct(F.array_compact(flags))))
    df = df.withColumn("fetch_status", F.when(F.array_contains("data_quality_flags", "html_listing_partial"), "partial").otherwise("ok"))
    # kept: the search for duplicates reads the rows four times, and each would clean the texts anew
    used = None if keep is None else {*keep, order, "record_id", "external_id", "url_hash", "content_hash", "data_quality_flags"}
    names = [c for c in df.columns if used is None or c in used]
    stored = [F.col(f"`{c}`") for c in dict.fromkeys("summary" if c == "summary_raw" else c for c in names)]
    df = materialize(df.select(*stored))
    if "summary_raw" in names:
        df = df.withColumn("summary_raw", F.col("summary")).select(*[F.col(f"`{c}`") for c in names])
    marked = mark_exact_duplicates(df, order)
    return marked if keep is None else marked.select(*keep)


def has_flag(flags: Column, flag: str) -> Column:
    return F.coalesce(F.array_contains(flags, F.lit(flag)), F.lit(False))


def explode_flags(df: DataFrame, flags: str = "data_quality_flags") -> DataFrame:
    """Distribution of flags: one row per flag with its count."""
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- pages
def extract_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``<a href=...>text</a>`` pairs of a page -> one row per link with an absolute URL."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""), 1)
    texts = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""), 2)
    z = pages.select("page_id", F.col(url).alias("page_url"), F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("link_pos", "l"))
    base = F.regexp_extract(F.col("page_url"), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(F.col("page_url"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    href = F.trim(F.col("l.href"))
    absolute = (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
                .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
                .when(F.startswith(href, F.lit("/")), F.concat(base, href))
                .otherwise(F.concat(F.regexp_replace(F.regexp_extract(F.col("page_url"), r"^([^?#]*/)", 1), r"/$", ""), F.lit("/"), href)))
    return z.select("page_id", F.col("link_pos").cast("bigint").alias("link_pos"), absolute.alias("link_url"),
                    X.clean_html(F.col("l.text")).alias("link_text"))


def listing_link_filter(links: DataFrame, keywords: Sequence[str], blocked: Sequence[str] = (), min_title: int = 8,
                        min_depth: int = 2) -> DataFrame:
    """Keep article-like links: title >= 8 chars, host not blocked, deep path or numeric-id suffix,
    a keyword in title or URL; repeats of a URL keep the first by (page, position)."""
    path = X.url_path("link_url")
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    numeric = path.rlike(r"\d{5,}(\.html?)?$")
    text = F.lower(F.concat_ws(" ", F.col("link_text"), F.col("link_url")))
    ok = (F.length("link_text") >= min_title) & ((depth >= min_depth) | numeric) & X.any_keyword(text, keywords)
    if blocked:
        ok = ok & ~X.any_keyword(F.lower(F.col("link_url")), blocked)
    kept = links.filter(ok)
    first = kept.groupBy("link_url").agg(F.min(F.struct("page_id", "link_pos")).alias("_f"))
    return kept.join(first, "link_url").filter((F.col("page_id") == F.col("_f.page_id")) & (F.col("link_pos") == F.col("_f.link_pos"))).drop("_f")


# ---------------------------------------------------------------- locations
# Fixed values of the search for place names: characters of a name that a position is looked up by, and of a piece of text.
NAME_HEAD, TEXT_PIECE = 6, 512
# Bits of the bitmap of heads (2 MB, whatever the gazetteer), and rows that a task gives out at once.
HEAD_BITS, HEAD_ROWS = 1 << 24, 1 << 14


def _head_slots(text: str, sizes: Sequence[int]):
    """(n, slots): the bitmap's slot of the n characters from each place of a text, for every n of ``sizes`` (ascending)."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, min(sizes[-1], len(chars)) + 1):
        h = h[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in sizes:
            yield n, ((h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _strings(column):
    return (x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in column)


def _head_bitmap(heads: DataFrame, sizes: Sequence[int]):
    """A broadcast bitmap of the heads: at most HEAD_BITS / 64 rows reach the driver; a full one only filters nothing."""
    def slots(batches):
        for batch in batches:
            at = [int(s[0]) for t in _strings(batch.column(0)) for n, s in _head_slots(t, sizes) if n == len(t)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["s"])

    words = heads.select("_head").mapInArrow(slots, "s long").selectExpr("int(shiftright(s, 6)) AS w", "shiftleft(1L, int(s % 64)) AS b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(HEAD_BITS >> 6, np.uint64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return heads.sparkSession.sparkContext.broadcast(bits)


def _name_places(bits, sizes: Sequence[int], size: int, longest: int):
    """(id, piece) -> (id, window, head) of the places among a piece's first ``size`` where a head may begin, by the bitmap."""
    def run(batches):
        for batch in batches:
            ids, rows, windows, heads = batch.column(0), [], [], []
            give = lambda: pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(windows, pa.string()), pa.array(heads, pa.string())], ["_id", "_window", "_head"])  # noqa: E731, B023
            for i, text in enumerate(_strings(batch.column(1))):
                for n, slots in _head_slots(text, sizes):
                    slots = slots[:size]
                    hit = (bits.value[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1)
                    for at in np.flatnonzero(hit).tolist():
                        rows.append(i)
                        windows.append(text[at : at + longest])
                        heads.append(text[at : at + n])
                if len(rows) >= HEAD_ROWS:
                    yield give()
                    rows, windows, heads = [], [], []
            yield give()

    return run


def find_names(df: DataFrame, text: str, id_col: str, gazetteer: DataFrame, name: str = "name") -> DataFrame:
    """(id, names): the distinct lower-cased names of the gazetteer that occur anywhere in the lower-cased text (inside words
    too), longest first, then by name.  Ids whose text holds none (or is null) have no row; rows with one id count as one text;
    empty and null names are never found.

    A join, whatever the size of the gazetteer.  Texts are cut into pieces that overlap by the longest name; each position of a piece is
    looked up by the first ``NAME_HEAD`` characters of names (shorter names by all of theirs), first in a bitmap of their hashes inside the
    task, so that only places where a name may begin become rows, then by the join.  A position that meets a
    head goes on with the lengths that names with this head have, each looked up by the whole string, so that a head
    shared by many names (one word for all streets) costs its distinct lengths and not its names."""
    names = materialize(gazetteer.select(F.lower(F.col(name)).alias("_name")).filter(F.length("_name") > 0).distinct())
    longest = names.agg(F.max(F.length("_name"))).first()[0] or 1
    heads = names.groupBy(F.substring("_name", 1, NAME_HEAD).alias("_head")).agg(F.collect_set(F.length("_name")).alias("_lens"))
    # at most NAME_HEAD numbers
    sizes = sorted(r[0] for r in heads.select(F.length("_head").alias("n")).distinct().collect())
    low = df.select(F.col(id_col).alias("_id"), F.lower(F.col(text)).alias("_low")).filter(F.length("_low") > 0)
    size = max(TEXT_PIECE, longest)
    cut = low.select("_id", F.regexp_extract_all("_low", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_cut"))
    ahead = lambda i: F.coalesce(F.get("_cut", i + 1).substr(1, longest - 1), F.lit(""))
    pieces = cut.select("_id", F.explode(F.transform("_cut", lambda c, i: F.concat(c, ahead(i)))).alias("_piece"))
    if not sizes:  # no name at all
        return df.select(F.col(id_col), F.array().cast("array<string>").alias("names")).limit(0)
    kind = T.StructType([low.schema["_id"], T.StructField("_window", T.StringType()), T.StructField("_head", T.StringType())])
    at = pieces.mapInArrow(_name_places(_head_bitmap(heads, sizes), sizes, size, longest), kind)
    met = at.join(heads, "_head").select("_id", "_window", F.explode("_lens").alias("_len"))
    met = met.filter(F.length("_window") >= F.col("_len")).select("_id", F.col("_window").substr(F.lit(1), F.col("_len")).alias("_name"))
    found = met.distinct().join(names, "_name", "left_semi")
    by_length = F.array_sort(F.collect_list(F.struct((-F.length("_name")).alias("n"), F.col("_name"))))
    return found.groupBy(F.col("_id").alias(id_col)).agg(F.transform(by_length, lambda x: x["_name"]).alias("names"))


def extract_locations(df: DataFrame, text: str, gazetteer: DataFrame, city: str | None = None, out: str = "locations") -> DataFrame:
    """Adds ``out``: all gazetteer places found in the text (see ``find_names``), city appended when
    absent; the first element is the primary location.  No place gives an empty list; every row of ``df`` stays.

    The names are found once per distinct text, by its digest, so that copies cost one search."""
    keyed = df.withColumn("_text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    texts = keyed.groupBy("_text_key").agg(F.first(F.col(text)).alias("_text"))
    names = find_names(texts, "_text", "_text_key", gazetteer).withColumnRenamed("names", "_found")
    found = F.coalesce(F.col("_found"), F.array().cast("array<string>"))
    j = keyed.join(names, "_text_key", "left")
    if city is not None:
        c = F.col(city)
        found = F.when(c.isNotNull() & ~F.array_contains(found, c), F.concat(found, F.array(c))).otherwise(found)
    return j.withColumn(out, found).drop("_text_key", "_found")


def geocode_join(df: DataFrame, gazetteer: DataFrame, location: str = "location_entity", city: str = "city") -> DataFrame:
    """Place -> (lat, lon, status) by a left join to a gazetteer table; unknown places fall back
    to the city centre; neither -> 'failed'. The size of the gazetteer decides the join, by Spark's statistics."""
    gz = gazetteer.select(F.lower(F.col("name")).alias("_g_name"), F.col("lat").alias("_g_lat"), F.col("lon").alias("_g_lon"))
    j = df.join(gz, F.lower(F.col(location)) == F.col("_g_name"), "left")
    centre = F.create_map(*[x for k, (la, lo) in CITY_CENTRES.items() for x in (F.lit(k), F.array(F.lit(la), F.lit(lo)))])
    c = F.element_at(centre, F.col(city))
    lat = F.coalesce(F.col("_g_lat"), c[0])
    lon = F.coalesce(F.col("_g_lon"), c[1])
    status = F.when(F.col("_g_lat").isNotNull(), "ok").when(c.isNotNull(), "city_fallback").otherwise("failed")
    return j.withColumns({"lat": lat, "lon": lon, "geocode_status": status}).drop("_g_name", "_g_lat", "_g_lon")


# Snap-distance thresholds (m) and confidences.
SNAP_HIGH_M, SNAP_MID_M = 50.0, 200.0
SNAP_CONF = (1.0, 0.7, 0.4, 0.3)


def snap_confidence(dist: Column, location: Column, mirrors: Column | None = None) -> Column:
    """Base by snap distance (<50 m 1.0, <200 m .7, else .4, null .3) + specificity bonus
    (.15 junction/bridge/tunnel words, .05 street words) + .05 per mirror (<= .15); cap 1."""
    base = F.when(dist.isNull(), SNAP_CONF[3]).when(dist < SNAP_HIGH_M, SNAP_CONF[0]).when(dist < SNAP_MID_M, SNAP_CONF[1]).otherwise(SNAP_CONF[2])
    low = F.lower(F.coalesce(location, F.lit("")))
    bonus = (F.when(X.any_keyword(low, ["ngã tư", "ngã ba", "cầu ", "hầm ", "nút giao"]), 0.15)
             .when(X.any_keyword(low, ["đường ", "phố ", "đại lộ", "quốc lộ"]), 0.05).otherwise(0.0))
    mir = F.least(F.coalesce(mirrors, F.lit(0)) * 0.05, F.lit(0.15)) if mirrors is not None else F.lit(0.0)
    return F.least(base + bonus + mir, F.lit(1.0))


def snap_to_segment(events: DataFrame, segments: DataFrame, cell_deg: float = 0.01, max_km: float | None = None) -> DataFrame:
    """Nearest segment (by haversine; on ties the least id) of each event point, whatever the distance.

    Rings of cells: an event probes its cell and the 8 around it by an equi-join.  The best segment found is the
    nearest one if it is no farther than the edge of the cells searched; other events go on to cells of twice the side, until none is
    left or the cells hold the whole globe.  Cells wrap round at 180 degrees.  Events at one place are searched once.

    Every row of ``events`` stays; an event without a position, or a table without segments, gives null.  ``max_km`` nulls ids
    (not distances) beyond it."""
    level = max(1, math.ceil(math.log2(360.0 / cell_deg)))
    seg = segments.select(F.col("segment_id").alias("_id"), F.col("lat").cast("double").alias("_sy"), F.col("lon").cast("double").alias("_sx")).dropna()
    points = events.select(F.col("lat").cast("double").alias("_y"), F.col("lon").cast("double").alias("_x")).dropna().distinct()
    open_, found = materialize(points), None
    while True:
        side, n = 360.0 / 2**level, 2**level
        row = lambda y: F.floor((y + 90.0) / side)
        column = lambda x: F.pmod(F.floor((x + 180.0) / side), F.lit(n))
        around = F.array(*[F.struct((row(F.col("_y")) + a).alias("r"), F.pmod(column(F.col("_x")) + b, F.lit(n)).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        probe = open_.select("_y", "_x", F.explode(F.array_distinct(around)).alias("_cell")).select("_y", "_x", "_cell.r", "_cell.c")
        met = probe.join(seg.select("*", row(F.col("_sy")).alias("r"), column(F.col("_sx")).alias("c")), ["r", "c"])
        met = met.withColumn("_d", haversine_km("_y", "_x", "_sy", "_sx") * 1000.0)
        best = met.groupBy("_y", "_x").agg(F.min(F.struct("_d", "_id")).alias("_b"))
        best = open_.join(best, ["_y", "_x"], "left").select("_y", "_x", "_b")
        if level == 1:  # three rows and two columns of 180 degrees: everything was searched
            last = best.filter("_b IS NOT NULL")
            found = last if found is None else found.unionByName(last)
            break
        # no point outside the cells is nearer than their edge; a meridian is nearest at another latitude than the event's
        south, west = (row(F.col("_y")) - 1) * side - 90.0, (F.floor((F.col("_x") + 180.0) / side) - 1) * side - 180.0
        dy = F.least(F.col("_y") - south, south + 3 * side - F.col("_y"))
        dx = F.least(F.col("_x") - west, west + 3 * side - F.col("_x"), F.lit(90.0))
        edge = F.least(F.radians(dy), F.asin(F.cos(F.radians("_y")) * F.sin(F.radians(dx)))) * (1000 * EARTH_RADIUS_KM * (1 - 1e-9))
        best = materialize(best.withColumn("_done", F.coalesce(F.col("_b._d") <= edge, F.lit(False))))
        done = best.filter("_done").select("_y", "_x", "_b")
        found = done if found is None else found.unionByName(done)
        open_ = best.filter("NOT _done").select("_y", "_x")
        if open_.isEmpty():
            break
        level -= 1
    near = found.select(F.col("_y").alias("_fy"), F.col("_x").alias("_fx"), F.col("_b._id").alias("snapped_segment_id"), F.col("_b._d").alias("snap_distance_m"))
    at = (F.col("lat").cast("double") == F.col("_fy")) & (F.col("lon").cast("double") == F.col("_fx"))
    kept = [F.col(f"`{c}`") for c in events.columns]
    out = events.join(near, at, "left").select(*kept, "snapped_segment_id", "snap_distance_m")
    if max_km is not None:
        out = out.withColumn("snapped_segment_id", F.when(F.col("snap_distance_m") <= max_km * 1000, F.col("snapped_segment_id")))
    return out


# ---------------------------------------------------------------- duplicates in ingest order
def mark_exact_duplicates(df: DataFrame, order: str = "ingest_order", partition_hint: str | None = None) -> DataFrame:
    """A row duplicates the first earlier row with the same external id, else URL hash, else
    content hash; it points to that row and gains the 'exact_duplicate' flag.

    The first row per key is a grouped ``min_by`` (combines map-side) joined back, so a key
    shared by a third of all rows is not sorted in one task.  Only keys with rows of different order can have a duplicate; these
    are kept, so that their number decides how the rows are joined: few keys move no row.  ``df`` is read four times."""
    out = df
    firsts = []
    for i, key in enumerate(("external_id", "url_hash", "content_hash")):
        first = (df.filter(F.col(key).isNotNull()).groupBy(key)
                 .agg(F.min_by(F.col("record_id"), F.col(order)).alias(f"_first_{i}"), F.min(F.col(order)).alias(f"_ford_{i}"), F.max(F.col(order)).alias("_last")))
        first = materialize(first.filter(F.col(f"_ford_{i}") < F.col("_last")).drop("_last"))
        out = out.join(first, key, "left")
        firsts.append(F.when(F.col(order) > F.col(f"_ford_{i}"), F.col(f"_first_{i}")))
    dup_of = F.coalesce(*firsts)
    out = out.withColumn("duplicate_of_record_id", dup_of).withColumn("is_exact_duplicate", dup_of.isNotNull())
    flags = F.coalesce(F.col("data_quality_flags"), F.array().cast("array<string>")) if "data_quality_flags" in df.columns else F.array().cast("array<string>")
    out = out.withColumn("data_quality_flags", F.when(F.col("is_exact_duplicate"), F.array_sort(F.array_union(flags, F.array(F.lit("exact_duplicate"))))).otherwise(flags))
    return out.drop(*[c for c in out.columns if c.startswith("_first_") or c.startswith("_ford_")])


def keep_best_per_group(df: DataFrame, group: str = "dedup_group_id", rel: str = "traffic_relevance_score",
                        sev: str = "severity_score", tiebreak: str = "event_id") -> DataFrame:
    """One row per group: highest relevance, then highest severity, then lowest ``tiebreak``.
    A grouped ``min_by`` (combines map-side; no per-group sort of all rows)."""
    rest = [c for c in df.columns if c != group]
    order = F.struct(F.negative(F.col(rel)), F.negative(F.col(sev)), F.col(tiebreak))
    best = df.groupBy(group).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("_b"))
    return best.select(group, *[F.col(f"_b.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- event rows
def resolve_event_time(published: Column, url_time: Column, text_time: Column, ingestion: Column, now: str) -> Column:
    """published -> URL -> text -> ingestion -> now, with source and confidence labels."""
    now_c = F.lit(now).cast("timestamp_ntz")
    return (F.when(published.isNotNull(), F.struct(published.alias("t"), F.lit("published_at").alias("source"), F.lit("high").alias("confidence")))
            .when(url_time.isNotNull(), F.struct(url_time.alias("t"), F.lit("source_url").alias("source"), F.lit("medium").alias("confidence")))
            .when(text_time.isNotNull(), F.struct(text_time.alias("t"), F.lit("title_or_summary").alias("source"), F.lit("medium").alias("confidence")))
            .when(ingestion.isNotNull(), F.struct(ingestion.alias("t"), F.lit("ingestion_time").alias("source"), F.lit("low").alias("confidence")))
            .otherwise(F.struct(now_c.alias("t"), F.lit("fallback_now").alias("source"), F.lit("low").alias("confidence"))))


def normalize_events(raw: DataFrame, now: str, rules=CATEGORY_RULES, planning=PLANNING_TERMS, active=ACTIVE_ROADWORK_TERMS,
                     infra=INFRA_TERMS, planned=PLANNED_ROADWORK_TERMS, ladder=SEVERITY_LADDER, planning_low=PLANNING_LOW_TERMS,
                     dampening=DAMPENING_TERMS, city_aliases=CITY_ALIASES, district_patterns=DISTRICT_PATTERNS,
                     road_pattern=ROAD_PATTERN) -> DataFrame:
    """Raw/Bronze articles -> normalised event rows: clean text, event time with source and
    confidence, city/district/road/location, category, severity, relevance, end time,
    per-category flags and ``is_relevant_for_traffic_model``."""
    title = X.clean_html(F.coalesce(F.col("title"), F.lit("")))
    summary = F.when(F.col("summary").isNotNull(), X.clean_html(F.col("summary")))
    df = raw.withColumns({"title_clean": title, "summary_text": summary, "image_url": X.extract_image_url("summary")})
    # the text is cleaned once, as a column that all rules read: an expression would be computed anew by each
    df = df.withColumn("full_text", full_text("title_clean", "summary_text"))
    text = F.col("full_text")
    pub = X.parse_utc(F.col("published_at"))
    ing = X.parse_utc(F.col("ingestion_time")) if "ingestion_time" in raw.columns else F.lit(None).cast("timestamp_ntz")
    chosen = resolve_event_time(pub, X.time_from_url("source_url"), X.time_from_text(text, now), ing, now)
    hint = F.col("city_hint") if "city_hint" in raw.columns else None
    city = detect_city_text(text, hint, city_aliases)
    district = extract_first(text, district_patterns)
    road_m = F.regexp_extract(text, road_pattern, 1)
    road = F.when(road_m != "", F.trim(F.regexp_replace(road_m, r"\s+", " ")))
    cls = classify_event(text, rules, planning, active, infra, planned)
    df = df.withColumns({
        "published_at_utc": pub, "_chosen": chosen, "_city": city, "district": district, "road_name": road,
        "_cls": cls,
    })
    df = df.withColumns({
        "event_time_start": F.col("_chosen.t"), "event_time_source": F.col("_chosen.source"),
        "event_time_confidence": F.col("_chosen.confidence"), "city": F.col("_city.city"),
        "location_text": F.coalesce(F.col("road_name"), F.col("district"), F.col("_city.alias")),
        "event_category": F.col("_cls.category"), "event_subtype": F.col("_cls.subtype"),
    })
    df = df.withColumn("geo_confidence", F.when(F.col("road_name").isNotNull(), 0.75).when(F.col("district").isNotNull(), 0.55)
                       .when(F.col("city").isNotNull(), 0.4).otherwise(0.0))
    df = df.withColumn("severity_score", score_severity(F.col("event_category"), F.col("full_text"), ladder, planning_low))
    df = df.withColumn("traffic_relevance_score", score_relevance(F.col("event_category"), F.col("severity_score"), F.col("full_text"),
                                                                  RELEVANCE_BASE, dampening))
    cat = F.col("event_category")
    df = df.withColumns({
        "event_time_end": event_window_end(F.col("event_time_start"), cat),
        "has_accident": (cat == "accident").cast("int"), "has_congestion": (cat == "congestion").cast("int"),
        "has_roadwork": cat.isin("roadwork_active", "roadwork_planned").cast("int"), "has_flood": (cat == "flood").cast("int"),
        "has_heavy_rain": (cat == "weather_disruption").cast("int"), "has_public_transport_issue": (cat == "public_transport").cast("int"),
        "has_airport_issue": (cat == "airport").cast("int"), "has_enforcement": (cat == "enforcement").cast("int"),
        "has_planned_event": (cat == "planned_event").cast("int"),
        "is_relevant_for_traffic_model": (F.col("city").isNotNull() & cat.isin(*ACTIVE_CATEGORIES)
                                          & (F.col("traffic_relevance_score") >= 0.55)).cast("int"),
    })
    return df.drop("_chosen", "_city", "_cls").withColumnRenamed("title", "title_raw").withColumnRenamed("title_clean", "title")


def silver_events(bronze: DataFrame, type_rules, gazetteer: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Lakehouse Silver events: first row per source URL, rule classification, dictionary
    locations (primary = longest), gazetteer geocode with city fallback, confidence."""
    from .aggregates import dedup_first_key

    d = dedup_first_key(bronze.filter(F.col("source_url").isNotNull()), ["source_url"], [order, "record_id"]) \
        .unionByName(bronze.filter(F.col("source_url").isNull()))
    text = F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("summary"), F.lit("")))
    d = d.withColumns({"event_type": classify_event_type(text, type_rules), "_article": text})
    d = extract_locations(d, "_article", gazetteer, "city", "extracted_locations").drop("_article")
    d = d.withColumn("location_entity", F.try_element_at(F.col("extracted_locations"), F.lit(1)))
    g = geocode_join(d, gazetteer, "location_entity", "city")
    conf = F.when(F.col("geocode_status") == "failed", F.lit(0.0)).otherwise(
        snap_confidence(F.lit(None).cast("double"), F.col("location_entity")))
    return g.withColumn("event_confidence", conf)
