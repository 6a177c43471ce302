"""Byte-level BPE and token counts against tiktoken."""

import base64
import hashlib
import random

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from roadlens.llm import bpe, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RAW = open(FILE, "rb").read()
RANKS = bpe.parse_ranks(RAW)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  ", "\n\n", " \n x", "a  b", "don't  they'll", "naïve café", "你好 世界", "😀😀", "\x1c\x85\xa0 x", "<|endoftext|>", "a" * 3000, "ab" * 2000, "​" * 50, " " * 2000 + "x", "x\r\n\ty"]


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "The", " ", " ", "\n", "é", "ß", "!!", "'s", "12", "ion", "\t", "中", "…", "  ", "thing", "q"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def decode(ids):
    return REFERENCE.decode_bytes(ids)


def test_segment_tree_merges_like_the_library():
    encoder = bpe.Encoder(RAW, public_tokenizers.PATTERN)
    for text in ODD + random_texts(1, 1500):
        assert list(memoryview(encoder.encode(text)).cast("i")) == REFERENCE.encode_ordinary(text), repr(text[:60])


SPACED = [" \u00a0 \u00a0", "a \u00a0 \u00a0b", "\n \n", "a\n \nb", "a \n b", "\n b", "\t ", "x\t ", "x \n", "x ", " x", "\u3000 \u2003 ", "\u00a0 x", "\x1c \x1c", " "]


def test_runs_of_white_space_with_lone_spaces_are_one_match():
    encoder = bpe.Encoder(RAW, public_tokenizers.PATTERN)
    merges = RANKS | {b"\n ": len(RANKS), b"\n \n": len(RANKS) + 1, b"\t ": len(RANKS) + 2}
    raw = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in merges.items())
    wider = bpe.Encoder(raw, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("wider", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    rng = random.Random(6)
    for text in SPACED + ["".join(rng.choice("ab \n\t\u00a0\u2003 ") for _ in range(rng.randint(1, 12))) for _ in range(2000)]:
        assert list(memoryview(encoder.encode(text)).cast("i")) == REFERENCE.encode_ordinary(text), repr(text)
        assert list(memoryview(wider.encode(text)).cast("i")) == library.encode_ordinary(text), repr(text)


def test_remembered_generations_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.Encoder(RAW, public_tokenizers.PATTERN)
    for text in random_texts(2, 300) * 2:
        assert list(memoryview(encoder.encode(text)).cast("i")) == REFERENCE.encode_ordinary(text)


def test_columns_round_trip_nulls_and_clashing_names(spark):
    texts = ODD + random_texts(3, 60) + [None, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("mine"))
    tok = bpe.BPE(spark, FILE, public_tokenizers.PATTERN)
    rows = docs.withColumn("ids", tok.encode()).withColumn("n", tok.count()).withColumn("back", tok.decode("ids")).collect()
    for r in rows:
        want = REFERENCE.encode_ordinary(r.text or "")
        assert r.ids == want and r.n == len(want) and bytes(r.back).decode() == (r.text or "")
    null = spark.sql("SELECT CAST(NULL AS array<int>) AS ids").select(tok.decode("ids").alias("b")).first()
    assert null.b is None
    assert docs.limit(0).select(tok.encode().alias("ids")).count() == 0


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("tokens"))
    texts = ODD + random_texts(4, 80) + [None]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path + "/documents.parquet")
    return path, dict(enumerate(texts))


def test_op1_contract(spark, sf):
    from roadlens.llm.queries import QUERIES

    path, texts = sf
    rows = QUERIES["op1_byte_bpe"](spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = REFERENCE.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op7_histogram_answers_every_limit(spark, sf, monkeypatch):
    from roadlens.llm.queries import QUERIES

    monkeypatch.setattr(token_counts, "BLOCK", 16)  # several blocks of lengths
    path, texts = sf
    lengths = [len(REFERENCE.encode_ordinary(t or "")) for t in texts.values()]
    sums = QUERIES["op7_token_counts"](spark, path)
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths) and r.docs_to == sum(x <= r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens) and r.total_tokens == sum(lengths)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
    limits = [0, 1, 7, 50, 10**6]
    assert {r.limit: (r.docs_over, r.truncated_tokens) for r in token_counts.at_limits(sums, limits).collect()} == {
        k: (sum(x > k for x in lengths), sum(min(x, k) for x in lengths)) for k in limits
    }
    for r in token_counts.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(x for x in lengths if sum(y <= x for y in lengths) >= r.fraction * len(lengths))


def test_token_counts_of_an_empty_table(spark):
    hist = token_counts.length_histogram(spark.createDataFrame([], "n long"), F.col("n"))
    assert token_counts.suffix_sums(hist).count() == 0


def test_lists_are_decoded_at_once():
    import pyarrow as pa

    tokens = pa.array([b"a", b"", b"\xff\x00", b"dd"], pa.binary())
    lists = pa.array([[3, 0], None, [], [2, 1, 2], [0]], pa.list_(pa.int32()))
    want = [b"dda", None, b"", b"\xff\x00\xff\x00", b"a"]
    for a, b in ((0, 5), (1, 4), (3, 5), (1, 2), (2, 3), (0, 0)):
        got = bpe._decode(lists.slice(a, b - a), tokens)
        got.validate(full=True)
        assert got.to_pylist() == want[a:b]
    for wrong in ([4], [-1], [None]):
        with pytest.raises((pa.ArrowException, ValueError, IndexError)):
            bpe._decode(pa.array([wrong], pa.list_(pa.int32())), tokens)
