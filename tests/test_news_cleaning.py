"""Cleaning of news texts: the shortcuts give what the plain rules give, and only the columns asked for are stored."""

from pyspark.sql import functions as F

from roadlens.functions import text as X
from roadlens.operators import news as N

TEXTS = ["", " ", "plain", "  two  spaces ", "a\n\nb\r\n\tc\x0b\x0cd", "x  y", "a & b", "A &amp;amp;lt; B", "1 < 2", "<b>bold</b> text", "a&nbsp;&#32;b",
         "<script>\nalert('&lt;')</script>  end", "&lt;i&gt;tag&lt;/i&gt;", "<IMG alt='' SRC=\"http://a/b?x=1&amp;y=2\">", "img src='a'", "Hà Nội  Đường", "İstanbul ÀÉ", None]


def test_shortcuts_equal_the_plain_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    plain = F.regexp_replace(X.unescape("t"), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"<[^>]+>", " "), r"\s+", " "))
    image = F.regexp_extract("t", r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1)
    pairs = {"clean": (X.clean_html("t"), plain), "html": (X.has_html("t"), F.col("t").rlike(r"<[^>]+>")),
             "image": (X.extract_image_url("t"), F.when(image != "", X.unescape(image))),
             "accents": (X.remove_accents_lower(F.lower(F.col("t"))), X.remove_accents("t"))}
    for r in df.select("t", *[F.struct(a.alias("now"), b.alias("rule")).alias(k) for k, (a, b) in pairs.items()]).collect():
        assert all(r[k].now == r[k].rule for k in pairs), r


def test_first_match_is_name_and_keyword(spark):
    rules = {"a": ["x", "y"], "none": [], "b": ["z", "x"]}
    df = spark.createDataFrame([("..yx",), ("z",), ("q",), (None,)], "t string")
    got = df.select(X.first_match(F.col("t"), rules).alias("m"), X.first_alias_rank(F.col("t"), rules).alias("n"), X.first_keyword(F.col("t"), rules).alias("k")).collect()
    assert [(r.m and r.m.name, r.m and r.m.keyword) for r in got] == [(r.n, r.k) for r in got] == [("a", "x"), ("b", "z"), (None, None), (None, None)]


def test_only_columns_asked_for_are_stored(spark, monkeypatch):
    rows = [(i, f"e{i}", "s", "rss", "Hà Nội &amp; b" if i else None, f"<p>a  b\n{i // 2}</p>", f"https://h/p/{i // 2}", "2024-01-01") for i in range(4)]
    raw = spark.createDataFrame(rows, "ingest_order int, external_id string, source string, provider string, title string, summary string, source_url string, published_at string")
    stored, keep = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df: (stored.append(df.columns), keep(df))[1])
    whole = N.bronze_news(raw, {"hanoi": ["hà nội"]}, {"k": ["b"]})
    few = N.bronze_news(raw, {"hanoi": ["hà nội"]}, {"k": ["b"]}, keep=["ingest_order", "data_quality_flags"])
    assert few.columns == ["ingest_order", "data_quality_flags"]
    assert sorted(few.collect()) == sorted(whole.select(*few.columns).collect())
    first = [c for c in stored if "record_id" in c and "data_quality_flags" in c]
    assert {"summary", "summary_text"} <= set(first[0]) and not {"summary", "summary_text", "title", "title_raw"} & set(first[1])
    assert all(("exact_duplicate" in r.data_quality_flags) == (r.ingest_order in (1, 3)) for r in few.collect())
