"""Phrases against plain Python on a small table of many repeats."""

import re
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from roadlens.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def expected(docs, least, longest, top):
    f = {}
    for _, text, lang in docs:
        count = f.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            count.update(tuple(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    rows = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        held = set()
        for q, c in found.items():
            held |= {q[s : s + m] for m in range(2, len(q)) for s in range(len(q) - m + 1) if c >= found[q[s : s + m]]}
        scored = []
        for p, a in found.items():
            if p not in held:
                score, _, l, r = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        rows += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(rows)


def corpus(rng, n):
    words = ["The", "the", "cat", "é", "dog", "x y", "a", "b", "c"]
    end = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! ", ";x:"]
    return [(i, "".join(rng.choice(words[:k]) + rng.choice(end[: rng.choice([1, 3, 9])]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for i, k in enumerate(rng.choices([3, 9], k=n))]


@pytest.mark.parametrize("least,longest,top", [(5, 5, 1000), (12, 3, 7), (1, 5, 50)])
def test_phrases_match_plain_python(spark, monkeypatch, least, longest, top):
    monkeypatch.setattr(collocations, "CHUNK", 300)  # many blocks
    docs = corpus(Random(least), 120) + [(900, None, "en"), (901, "", None), (902, "the cat " * 400, "fr"), (902, "the cat " * 400, "fr"), (903, "\u0000 z \u0000 z", "und")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("rank", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in collocations.collocations(df, least, longest, top).collect()]
    assert sorted(got) == expected(docs, least, longest, top)


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    docs = corpus(Random(3), 80)
    df = spark.createDataFrame(docs, SCHEMA)
    monkeypatch.setattr(collocations, "SLOTS", 64)  # every phrase passes: the counts decide alone
    assert sorted(tuple(r) for r in collocations.collocations(df, 6).collect()) == expected(docs, 6, 5, 2000)


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([(10**13, 10**13, 10**13)], "a long, l long, r long").selectExpr(f"{collocations.score('a', '10000000000000L', 'l', 'r')} AS s").first()
    assert found.s == 1000


def test_empty_table(spark):
    out = collocations.collocations(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(t == "bigint" for c, t in out.dtypes if c not in ("lang", "phrase"))


def test_blocks_travel_in_small_batches(spark, monkeypatch):
    key, seen, relation = "spark.sql.execution.arrow.maxBytesPerBatch", [], collocations._relation
    before = spark.conf.get(key)
    monkeypatch.setattr(collocations, "_relation", lambda rows, label: (seen.append(spark.conf.get(key)), relation(rows, label))[1])
    collocations.frequent_phrases(spark.createDataFrame([("en", "a b c " * 3)], "lang string, text string"), 2, 3)
    assert set(seen) == {"8m"} and spark.conf.get(key) == before
