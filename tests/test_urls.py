"""URL forms against the standard library's parser."""

import re
from urllib.parse import parse_qs, parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import functions as F

from roadlens.functions import text as X

URLS = [
    "HTTPS://Example.COM//a///b/?b=2&a=%20x+y&utm_source=q&UTM_x=1&a=1#frag", "http://h.vn/p/?x&y=&=z&&k=v=w", "http://h.vn/?q=%C4%91%C6%B0%E1%BB%9Dng&t=~*-._",
    "http://h.vn/a%2Fb/?p=100%&r=%zz&fbclid=9", "http://H.vn", "http://h.vn/x/?gclid=1", " http://h.vn/a?ref=1&source=s&b=1&a=2&b=3&reference=4 ", "http://h.vn/a#x?y=1",
]


def canonical(u):
    s = urlsplit(u.strip())
    drop = lambda k: k.lower().startswith("utm_") or k.lower() in ("fbclid", "gclid", "yclid")
    items = sorted(i for i in parse_qsl(s.query, keep_blank_values=True) if not drop(i[0]))
    return urlunsplit((s.scheme, s.netloc.lower(), re.sub("/{2,}", "/", s.path).rstrip("/"), urlencode(items), ""))


def feed(u):
    s = urlsplit(u.strip())
    items = [i for i in parse_qsl(s.query, keep_blank_values=True) if not i[0].lower().startswith("utm_") and i[0].lower() not in ("fbclid", "gclid")]
    return urlunsplit((s.scheme, s.netloc, s.path.rstrip("/"), urlencode(items), ""))


def dedup(u):
    s = urlsplit(u.strip())
    items = {k: v for k, v in parse_qs(s.query).items() if not k.startswith(("utm_", "fbclid", "gclid", "ref", "source"))}
    return urlunsplit((s.scheme, s.netloc, s.path, urlencode(items, doseq=True), "")).rstrip("/")


def test_url_forms(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, None]], "u string")
    got = {r.u: r for r in df.select("u", X.canonical_url("u").alias("c"), X.feed_url("u").alias("f"), X.dedup_url("u").alias("d")).collect()}
    for u in URLS:
        assert (got[u].c, got[u].f, got[u].d) == (canonical(u), feed(u), dedup(u)), u
    assert tuple(got[None]) == (None,) * 4
    again = df.select(X.canonical_url("u").alias("u")).filter(F.col("u") != X.canonical_url("u"))
    assert again.count() == 0
