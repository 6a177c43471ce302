"""Registered queries against their SQL on a small table, and the pipeline against plain Python."""

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from roadlens.llm import bpe, queries
from roadlens.llm.common import table
from tools.oracle_check import digest, duck_connect, type_mismatches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    duck = duck_connect(SF)
    sdf = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in sdf.collect()]
    found = duck.execute(queries.ORACLES[name])
    columns, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(sdf.columns) == sorted(columns) and len(rows) == len(want)
    assert not type_mismatches(sdf, duck, queries.ORACLES[name])
    assert digest(sdf.columns, rows)[0] == digest(columns, want)[0]


def test_every_operator_and_the_pipeline_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"] is corpus_pipeline.run and "pipeline" not in E.oracle_sql()
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def edge_tables(spark, tmp_path_factory):
    """documents of sf0.001 with odd rows and a column that clashes with what operators produce."""
    path = str(tmp_path_factory.mktemp("edge"))
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame(
        [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, " \n ", "en", None, 3), (1003, "w" * 30000, "en", "z", 30000), (None, "no id here", "en", "z", 10)],
        docs.schema,
    )
    docs.unionByName(odd).unionByName(docs.filter("doc_id < 3")).withColumn("size", F.lit("mine")).write.parquet(path + "/documents.parquet")
    table(spark, SF, "labels").write.parquet(path + "/labels.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_survive_odd_rows(spark, edge_tables, name):
    n = table(spark, edge_tables, "documents").count()
    rows = queries.QUERIES[name](spark, edge_tables).collect()
    assert rows if name in ("op7_token_counts", "op12_collocations", "quality_ablations") else len(rows) == n


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_survive_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels"):
        table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    left = {i: r.text for i, r in docs.items() if brute.kept(r.text)[1]}
    clean = brute.dedup_lines(left)
    clean = {i: t for i, t in clean.items() if t == left[i] or brute.words(t)}
    group = brute.components({i: brute.shingles(t) for i, t in clean.items()})
    single = {i: t for i, t in clean.items() if group[i] == i}
    spark.createDataFrame([(i, t, docs[i].source) for i, t in single.items()], "doc_id long, text string, source string").createOrReplaceTempView("single")
    duck = duck_connect(SF)
    rows = [(i, t, docs[i].source) for i, t in single.items()]
    duck.execute("CREATE TABLE single (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO single VALUES (?, ?, ?)", rows)
    mix = queries._OP5_SQL.replace("FROM documents)", "FROM single)")
    copies = {r[0]: r[1] for r in duck.execute(f"SELECT doc_id, copies FROM ({mix})").fetchall()}
    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, own.encode_ordinary(t)) for i, t in single.items() for _ in range(copies[i]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns_of_documents(spark, edge_tables):
    docs = table(spark, edge_tables, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge_tables)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), edge_tables).count() == 0


def test_stages_leave_clean_documents_alone(spark):
    from random import Random

    rng = Random(7)
    rows = [(i, ". ".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(9)) for _ in range(20)), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert sorted((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()) == sorted((r[0], r[1]) for r in rows), name
