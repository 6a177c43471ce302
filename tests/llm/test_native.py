"""Mixing, line dedup and sharding against plain Python."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from roadlens.llm import line_dedup, mixing, sharding

DOCS = "doc_id long, text string, source string"


def random_lines(seed, n=60):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["tide", "moss", "oak", "fern", "reed"]) for _ in range(rng.randint(1, 6))) for _ in range(25)] + ["", " "]
    passage = [f"shared line {k} of a passage" for k in range(12)]
    out = []
    for i in range(n):
        own = [rng.choice(pool) + f" {rng.randint(0, 400)}" * rng.randint(0, 1) for _ in range(rng.randint(0, 9))]
        at = rng.randint(0, len(own))
        out.append((i, "\n".join(own[:at] + passage * (i % 3 == 0) + own[at:]), f"s{i % 4}"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(spark, seed):
    rows = random_lines(seed) + [(900, None, "a"), (901, "", "a"), (902, "one line only", "a"), (903, "one line only", "a"), (904, "x\n" * 4000 + "y", None)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute.dedup_lines({r[0]: r[1] for r in rows})
    assert {i: got[i].text for i in got} == want
    assert sum(r.n_removed_chunks for r in got.values()) > 10
    for i, text, _ in rows:
        assert got[i].n_lines == (0 if text is None else len(text.split("\n")))


def test_line_dedup_removes_a_shifted_passage_and_exact_copies(spark):
    passage = "\n".join(f"line {k} of the passage that many texts share" for k in range(30))
    rows = [(1, "head a\n" + passage + "\ntail a", "s"), (2, "other head\nand more\n" + passage, "s"), (3, "head a\n" + passage + "\ntail a", "s")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].n_removed_lines == 30 and got[2].n_removed_chunks > 0 and got[2].n_removed_passages == 1 and got[2].text == "other head\nand more"
    assert got[3].text == ""


def test_line_dedup_repeated_rows_clashing_columns_and_empty(spark):
    text = "a b\nc d\ne f\ng h\ni j"
    rows = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (None, text, None)], DOCS).withColumn("n_lines", F.lit("mine")).withColumn("body", F.lit(7))
    got = line_dedup.dedup_lines(rows)
    assert got.columns == ["doc_id", "text", "source", "body", "n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_passages"]
    found = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.n_removed_lines))
    assert [r.text for r in found] == [text, text, ""]
    empty = line_dedup.dedup_lines(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and "text" in empty.columns


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_line_dedup_removes_short_passages_and_edges(spark, n):
    passage = "\n".join(f"line {k} of the shared passage" for k in range(n))
    rows = [(i, f"head {i}\nown {i}\n{passage}\ntail {i}\nend {i}", "s") for i in range(4)] + [(8, "a\n\n\n\nb", "s"), (9, "a\n\n\n\nb", "s")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed_lines == 0 and got[8].n_removed_lines == 0
    for i in (1, 2, 3):
        assert got[i].text == f"head {i}\nown {i}\ntail {i}\nend {i}" and (got[i].n_removed_lines, got[i].n_removed_passages) == (n, 1)
    assert got[9].n_removed_lines >= 4


@pytest.mark.parametrize("n", [2, 3, 5])
def test_passages_between_different_lines_go_whole(spark, n):
    passage = "\n".join(f"line {k} of the shared passage" for k in range(n))
    rows = [(i, f"head {i}\nown {i}\n{passage}\ntail {i}\nend {i}", "s") for i in range(4)] + [(9, None, "s"), (10, passage, "s"), (11, passage + "\n" + passage, "s"), (12, "one line only", "s"), (13, "one line only", "s")]
    got = {r.doc_id: r for r in line_dedup.dedup_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed_lines == 0 and got[9].text is None
    for i in (1, 2, 3):
        assert got[i].text == f"head {i}\nown {i}\ntail {i}\nend {i}" and got[i].n_removed_lines == n and got[i].n_removed_passages == 1
    assert got[10].text == got[11].text == "" and got[11].n_removed_lines == 2 * n
    assert got[12].text == got[13].text == "one line only"


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_match_brute_force_and_keep_every_line_once(spark, seed):
    rows = random_lines(seed) + [(900, None, "a"), (901, "", "a"), (904, "x\n" * 4000 + "y", None)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_passages(spark.createDataFrame(rows, DOCS)).collect()}
    seen, want = set(), {}
    for i, text, _ in rows:
        lines, lost = (text or "").split("\n"), set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            if brute.words("\n".join(pair)):
                lost |= {k, k + 1} if pair in seen else set()
                seen.add(pair)
        want[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in lost)
    assert got == want
    every = lambda texts: {x for t in texts if t for x in t.split("\n") if brute.words(x)}
    assert every(got.values()) == every(r[1] for r in rows)


def test_passages_match_sql_on_documents(spark):
    SF_SMALL = "/root/testdata/sf0.001"
    from roadlens.llm import queries
    from tools.oracle_check import duck_connect

    want = duck_connect(SF_SMALL).execute(queries.ORACLES["passage_dedup"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["passage_dedup"](spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want) and sum(r[3] for r in got) > 0


SIZED = "doc_id long, source string, size long"


def test_mixing_targets_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["b", "a", None, "c", "é"] + ["hot"] * 4), int(rng.lognormvariate(4, 1.2))) for i in range(4000)]
    rows += [(9000, "none", 0), (9001, "none", 0), (9002, "a", 0)]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute.targets(sizes)
    plan = mixing.copies_plan(spark.createDataFrame(rows, SIZED)).collect()
    assert len(plan) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    longest = max(r[2] for r in rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest, s
    again = mixing.copies_plan(spark.createDataFrame(rows, SIZED).repartition(7))
    assert sorted((r.doc_id, r.copies) for r in plan) == sorted((r.doc_id, r.copies) for r in again.collect())


def test_mixing_emits_rows_with_their_columns(spark):
    rows = [(i, "w " * (i % 9), "s" if i % 2 else "t") for i in range(200)] + [(5, "w w", None), (5, "w w", None), (None, None, "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    plan = mixing.copies_plan(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("w")).cast("long").alias("size")))
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0


def shard_rows(spark, rows, n=7):
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n)
    return out, out.collect()


def test_shards_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randint(0, 90) + str(rng.randint(0, 40))) for i in range(1500)] + [(2000, None), (2001, ""), (None, "x"), (2002, "long " * 5000)]
    out, got = shard_rows(spark, rows)
    assert sorted(map(str, ((r.doc_id, r["size"], r.shard, r.slot) for r in got))) == sorted(map(str, brute.shards(rows, 7)))
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)


def test_shards_cut_a_hot_text_and_leave_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_ROWS", 50)
    rows = [(i, "the same text " * 4) for i in range(3000)] + [(9000 + i, f"t{i}") for i in range(3000)] + [(1, "dup")] * 3
    _, got = shard_rows(spark, rows, 10)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(10))
    total = sum(r["size"] for r in got)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 10) <= 2 * max(r["size"] for r in got)
    cuts = sharding.splitters(sharding.record_sizes(spark.createDataFrame(rows, "doc_id long, text string")))
    hot = brute.bits("the same text " * 4, 15)
    assert sum(k == hot for k, _ in cuts) > 10


def test_shards_of_an_empty_table_and_written_files(spark, tmp_path):
    assert shard_rows(spark, [])[1] == []
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").withColumn("size", F.lit("mine"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {"doc_id", "text", "size"} <= set(back.columns)
    assert len(list((tmp_path / "out").glob("__shard=*"))) == 4
