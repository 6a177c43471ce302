"""Quality rules, the Jaccard join and spot signatures against plain Python."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import jaccard_join, quality_rules, spotsigs

DOCS = "doc_id long, text string"
ODD = [None, "", " \n\t ", " word one", "a b c a b c", "x\n\nx\ny\n x", "#*$ |<>& %", "ÉCOLE École", "w " * 60, "one two three " * 40, "A B C D " * 30, "\x0b\x0c\r"]


def random_text(rng):
    return "".join(rng.choice(["the", "Tide", " ", " ", "\n", "#", "|", "é", "MOSS", "\t", "a b c"]) for _ in range(rng.randint(0, 200)))


def test_rule_ledger_matches_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + [random_text(rng) for _ in range(200)] + [" ".join(f"clean{k}" for k in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("failures", F.lit("mine")).withColumn("other", F.lit(1))
    led = quality_rules.ledger(docs)
    assert led.columns[:3] == ["doc_id", "text", "other"] and dict(led.dtypes)["failures"] == "bigint"
    rows = led.withColumn("kept", quality_rules.passes("v1")).withColumn("base", quality_rules.passes("base")).collect()
    for r in rows:
        bad, kept = brute.kept(r.text)
        assert {m: r[m] for m in quality_rules.MEASURES} == brute.measures(r.text), repr(r.text)
        assert r.failures == sum(1 << i for i, b in enumerate(bad) if b) and r.kept == kept and r.base == (not any(bad[:2]))
    for r in quality_rules.ablations(led).collect():
        bit = quality_rules.bit(r.rule)
        fails = [x.failures for x in rows]
        assert (r.n_docs, r.n_failed, r.n_kept) == (len(fails), sum(f & bit > 0 for f in fails), fails.count(0))
        assert r.n_kept_without == sum(f & ~bit == 0 for f in fails)
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return words


def near_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice([6, 9, 14, 40, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            rows.append(edited(rng, words, rng.randint(0, max(1, len(words) // 30))))
        chain = words
        for _ in range(3):  # links that reach on
            chain = edited(rng, chain, max(1, len(words) // 40))
            rows.append(chain)
        rows.append(words[: len(words) * 4 // 5])
        rows.append(passage + [rng.choice(vocab) for _ in range(80)])
    rows = [" ".join(w) for w in rows] + [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows += ["one", "ONE", "one two", "One Two Three", "", None, "  "]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2000)  # several blocks and ranges
    if seed == 3:
        monkeypatch.setattr(jaccard_join, "size_boundary", lambda *a: 30)  # both light and heavy sets
    rows = near_rows(seed)
    sets = {i: brute.shingles(t) for i, t in rows}
    want = brute.components(sets)
    got = jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("tile,cost", [(3, 0.0), (3, 1e9), (2, 0.05)])
def test_jaccard_large_groups_by_leaders_tiles_and_pairs(spark, monkeypatch, tile, cost):
    """Groups above the tile size: tiles of blocks (cost 0), pairs of a bucket (cost high)."""
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile)
    monkeypatch.setattr(jaccard_join, "TILE_COST", cost)
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 300)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [" ".join(edited(rng, base, rng.randint(0, 9))) for _ in range(70)] + [t for _, t in near_rows(5)[:60]]
    rows = list(enumerate(rows))
    got = jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.components({i: brute.shingles(t) for i, t in rows})


def test_jaccard_hot_groups_and_threshold(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base)) for i in range(0, 300)] + [(1000 + i, " ".join(edited(rng, base, 1))) for i in range(300)]
    exact = [f"t{k}" for k in range(7)]  # 3 shingles; with one more word 4: exactly 75 percent
    rows += [(5000, " ".join(exact)), (5001, " ".join(exact + ["x"])), (5002, " ".join(exact + ["x", "y"]))]
    rows += [(6000, " ".join(["common"] * 9 + [f"z{k}" for k in range(40)])), (6001, " ".join(["common"] * 9 + [f"y{k}" for k in range(40)]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[i] for i, _ in rows if i < 5000} == {0}
    assert (got[5000], got[5001], got[5002]) == (5000, 5000, 5000)
    assert (got[6000], got[6001]) == (6000, 6001)


def test_keep_one_of_each_keeps_columns_repeats_and_nulls(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(3, text), (1, text), (7, text + " x"), (None, text), (4, None), (5, ""), (6, "short")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("mine")).withColumn("digest", F.lit(2))
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6)]  # a copy without an id goes as well
    assert jaccard_join.near_duplicate_groups(docs.limit(0)).count() == 0


def test_pruned_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(400):
        pool = rng.integers(0, 120, 150).astype(np.uint64)
        a, b = np.unique(pool[: rng.integers(0, 90)]), np.unique(pool[rng.integers(0, 60) :][: rng.integers(0, 90)])
        sa, sb = set(a.tolist()), set(b.tolist())
        want = len(sa & sb) / len(sa | sb) if sa and sb else float(sa == sb)
        assert spotsigs.pruned_jaccard(a, b) == want
        for least in (0.3, 0.75, 0.9):
            got = spotsigs.pruned_jaccard(a, b, least)
            assert got == want if want >= least else got < least


def spot_set(text):
    plain = [w for w in map(spotsigs.normal, (text or "").split()) if w]
    out = set()
    for i, w in enumerate(plain):
        if w in spotsigs.ANCHORS:
            chain = [x for x in plain[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out or ({tuple(plain)} if plain else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(a == b)


def test_spotsigs_compare_with_next(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK_BYTES", 3000)  # many blocks
    rng = random.Random(4)
    vocab = ["the", "of", "and", "der", "la"] * 6 + [f"w{k}" for k in range(60)] + ["Moss,", "É.", "—", "\n"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120))) for _ in range(120)] + ["", None, "x", "—", "the", "😀" * 9]
    ids = rng.sample(range(10**6), len(texts))
    rows = sorted(zip(ids, texts))
    got = {r.doc_id: r for r in spotsigs.compare_with_next(spark.createDataFrame(rows, DOCS).withColumn("fingerprint", F.lit(1))).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        text, behind = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + behind[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.n_signatures == len(spot_set(text)) and len(r.fingerprint) == 8 * r.n_signatures
        assert r.near_edited == pytest.approx(jaccard(spot_set(text), spot_set(changed)))
        assert r.near_next == pytest.approx(jaccard(spot_set(text), spot_set(behind)))


def test_spotsigs_repeated_rows_single_rows_and_empty(spark):
    one = spotsigs.compare_with_next(spark.createDataFrame([(5, "the moss grows on")], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(1, "the moss grows"), (1, "the moss grows"), (1, "the fern grows"), (None, "the reed grows")]
    got = spotsigs.compare_with_next(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 1}) == 2
    assert spotsigs.compare_with_next(spark.createDataFrame([], DOCS)).count() == 0


def test_spotsigs_near_duplicates(spark):
    rng = random.Random(6)
    vocab = ["the", "of", "and"] * 8 + [f"w{k}" for k in range(900)]
    rows, sets = [], {}
    for base in range(15):
        words = [rng.choice(vocab) for _ in range(rng.choice([8, 60, 200]))]
        rows += [" ".join(edited(rng, words, k % 3)) for k in range(5)]
    rows = [(i, t) for i, t in enumerate(rows + ["", None])]
    sets = {i: frozenset(spot_set(t)) for i, t in rows}
    got = spotsigs.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.components(sets)


def test_keep_one_of_each_tells_repeated_ids_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, None), (None, " "), (9, b + " more"), (9, b + " more")]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (5, b), (None, None), (None, " ")], key=str)
