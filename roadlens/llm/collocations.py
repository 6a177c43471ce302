"""Phrase collocations by SETM: sorted occurrence relations, merge-joined, counted and semi-joined level by level.

*Relation.*  R_k holds every occurrence of a k-word phrase that may be frequent.  It is stored sorted by piece and position, in
blocks of ``CHUNK`` occurrences: a block lists, position by position, which phrase of the block's own dictionary
begins there (0: none, or the gap between two pieces), so that neighbours in a block are neighbours in a piece.

*Level.*  (1) R_k is semi-joined with the frequent groups F_k: occurrences of others become 0.  (2) The rest is merge-joined with
itself by piece and adjacent position: two k-word phrases that begin at p and p + 1 make the (k + 1)-word phrase
at p.  (3) These are counted per block, per task and then by Spark's aggregation; those found ``least`` times are F_(k+1).

The semi-join reads F_k as a bitmap of ``SLOTS`` bits (16 MB, whatever the data), as a Bloom filter: a phrase that slips through
only makes longer phrases that the next count drops, so results are exact.  A phrase is named by 64 bits
that mix the names of its two parts; strings are put together for frequent phrases only.

A block ends between two pieces.  Memory: some blocks (a batch of 8 MB, or one), their dictionaries and the bitmap per task.  Shuffles: distinct phrases
per task.  R_k is removed once R_(k+1) is stored.

Defined cases: null text is empty; null lang is ``und``; rows that repeat count again; an empty table gives no phrases.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLOTS, bitmap_filter, in_bitmap, scratch_path, small_batches, stored, whole_text

#: Characters that end a piece.
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
LEAST = 100
LONGEST = 5
TOP = 2000
CHUNK = 1 << 18
#: Parts that a language's candidates are ranked in before they are ranked as a whole.
RANK_PARTS = 64
#: A block tells the parts of one in so many of its phrases, at first.
SHARE = 32
_GAP = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if chr(b) in SEPARATORS else 0x20 if b == 9 else b for b in range(256))

_BLOCK = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("n", T.LongType()),  # occurrences
    T.StructField("at", T.BinaryType()),  # int32 by position: number in the dictionary from 1, or 0
    T.StructField("words", T.BinaryType()),  # of the dictionary, joined by spaces; words only
    T.StructField("lefts", T.BinaryType()),  # names of a phrase's two parts; the name itself of a word
    T.StructField("rights", T.BinaryType()),  # phrases only
    T.StructField("counts", T.BinaryType()),  # int32
])
_BLOCK_ARROW = pa.schema([("lang", pa.string()), ("n", pa.int64()), *[(c, pa.binary()) for c in _BLOCK.names[2:]]])


class _Numbers(dict):
    """Words numbered as they come; 0 is the gap between pieces."""

    def __init__(self):
        super().__init__({_GAP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _block(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns.get(f.name)], f.type) for f in _BLOCK_ARROW], schema=_BLOCK_ARROW)


def _word_block(lang: str, numbers: _Numbers, parts: list) -> pa.RecordBatch:
    at = np.concatenate(parts)
    words = list(numbers)[1:]
    seed = zlib.crc32(lang.encode())
    codes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    counts = np.bincount(at, minlength=len(numbers))[1:]
    return _block(lang=lang, n=int(counts.sum()), at=at.tobytes(), words=b" ".join(words), lefts=codes.tobytes(), counts=counts.astype(np.int32).tobytes())


def _portions(words: list):
    """A text's words in portions of whole pieces, of CHUNK words or one piece."""
    while len(words) > CHUNK:
        cut = CHUNK
        while cut < len(words) and words[cut - 1] != _GAP:
            cut += 1
        yield words[:cut]
        words = words[cut:]
    yield words


def _tokenize(batches):
    """Texts -> blocks of word occurrences, by language."""
    held: dict[str, tuple] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = text.as_buffer().to_pybytes().lower().translate(_TABLE).replace(_GAP, b" \xff ").split()
            words.append(_GAP)
            for portion in _portions(words):
                numbers, parts = held.setdefault(lang, (_Numbers(), []))
                parts.append(np.fromiter(map(numbers.__getitem__, portion), np.int32, len(portion)))
                size += len(portion)
                if size >= CHUNK:
                    for name, (known, made) in held.items():
                        yield _word_block(name, known, made)
                    held, size = {}, 0
    for name, (known, made) in held.items():
        yield _word_block(name, known, made)


def _cells(batch, kinds: dict):
    """Rows of a batch as arrays over its buffers (None for a null)."""
    columns = [(batch.column(batch.schema.get_field_index(c)), kind) for c, kind in kinds.items()]
    for i in range(batch.num_rows):
        yield [np.frombuffer(c[i].as_buffer(), kind) if c[i].is_valid else None for c, kind in columns]


def _name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The 64-bit name of the phrase made of two others that overlap."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_DICTIONARY = {"lefts": np.uint64, "rights": np.uint64}


def _names(lefts, rights) -> np.ndarray:
    return lefts if rights is None else _name(lefts, rights)


def _extend(bits):
    """Blocks of k-word phrases -> blocks of (k + 1)-word phrases: semi-join with the bitmap, merge-join of neighbours."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, (at, lefts, rights) in zip(langs, _cells(batch, {"at": np.int32, **_DICTIONARY})):
                codes = _names(lefts, rights)
                at = np.where(np.concatenate([[False], in_bitmap(bits.value, codes)])[at], at, 0)
                here = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
                if not len(here):
                    continue
                width = len(codes) + 1
                pairs, number, counts = np.unique(at[here].astype(np.int64) * width + at[here + 1], return_inverse=True, return_counts=True)
                longer = np.zeros(len(at), np.int32)
                longer[here] = number + 1
                yield _block(
                    lang=lang, n=len(here), at=longer.tobytes(), lefts=codes[pairs // width - 1].tobytes(), rights=codes[pairs % width - 1].tobytes(),
                    counts=counts.astype(np.int32).tobytes(),
                )

    return run


_WORD_ARROW = pa.schema([("lang", pa.string()), ("word", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
_COUNT_ARROW = pa.schema([("code", pa.int64()), ("n", pa.int64())])
_PART_ARROW = pa.schema([("code", pa.int64()), ("left", pa.int64()), ("right", pa.int64())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _word_counts(batches):
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, (words, codes, counts) in zip(langs, _cells(batch, {"words": np.uint8, "lefts": np.int64, "counts": np.int32})):
            words = words.tobytes().decode().split(" ") if len(words) else []
            yield _batch(_WORD_ARROW, [lang] * len(words), words, codes, counts.astype(np.int64))


def _combined(codes: list, counts: list) -> pa.RecordBatch:
    code, number = np.unique(np.concatenate(codes), return_inverse=True)
    return _batch(_COUNT_ARROW, code.view(np.int64), np.bincount(number, weights=np.concatenate(counts)).astype(np.int64))


def _phrase_counts(batches):
    """Counts of blocks, combined in the task, some blocks at a time."""
    codes, counts, size = [], [], 0
    for batch in batches:
        for lefts, rights, n in _cells(batch, {**_DICTIONARY, "counts": np.int32}):
            codes.append(_names(lefts, rights))
            counts.append(n.copy())
            size += len(n)
            if size >= 2 * CHUNK:
                yield _combined(codes, counts)
                codes, counts, size = [], [], 0
    if codes:
        yield _combined(codes, counts)


def _parts(bits, share: int):
    """The parts of the frequent phrases of blocks; a block tells those of one phrase in ``share``, each block others."""

    def run(batches):
        for batch in batches:
            for lefts, rights in _cells(batch, _DICTIONARY):
                codes = _names(lefts, rights)
                turn = (codes ^ codes[0]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                keep = in_bitmap(bits.value, codes) & (turn % np.uint64(share) == 0)
                yield _batch(_PART_ARROW, codes[keep].view(np.int64), lefts[keep].view(np.int64), rights[keep].view(np.int64))

    return run


def _parts_of(relation: DataFrame, groups: DataFrame, bits) -> DataFrame:
    """(code, left, right) of every frequent group.  A phrase is in many blocks and one tells enough: first each block tells a share
    of its phrases, then all tell those that none has told yet."""
    told = lambda b, share: relation.select("lefts", "rights").mapInArrow(_parts(b, share), "code long, left long, right long")
    once = lambda df: df.groupBy("code").agg(F.min("left").alias("left"), F.min("right").alias("right"))
    first = stored(groups.select("code").join(once(told(bits, SHARE)), "code"), "parts")
    rest = stored(groups.select("code").join(first, "code", "left_anti"), "parts-open")
    if rest.isEmpty():
        return first
    left_over = bitmap_filter(rest, "code", SLOTS)
    second = stored(rest.join(once(told(left_over, 1)), "code"), "parts-rest")
    left_over.unpersist()
    return first.unionByName(second)


def _relation(rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A relation stored sorted, in small row groups, since a row is a whole block."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return rows.sparkSession.read.schema(_BLOCK).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch table of this job that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, n) word occurrences of each language, (lang, k, phrase, f, code, left, right) of all phrases of 1 to ``longest`` words
    found ``least`` times or more).  All is stored on return."""
    with small_batches(docs.sparkSession):
        return _frequent_phrases(docs, least, longest)


def _frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().cast("binary").alias("text"))
    relation, path = _relation(rows.mapInArrow(_tokenize, _BLOCK), "occurrences-1")
    total = stored(relation.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = relation.select("lang", "words", "lefts", "counts").mapInArrow(_word_counts, "lang string, word string, code long, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.min("code").alias("code")).filter(F.col("f") >= least)
    none = F.lit(None).cast("long")
    level = stored(words.select("lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "f", "code", none.alias("left"), none.alias("right")), "phrases-1")
    bits = bitmap_filter(level, "code", SLOTS)
    every = level
    for k in range(2, longest + 1):
        longer, longer_path = _relation(relation.select("lang", "at", "lefts", "rights").mapInArrow(_extend(bits), _BLOCK), f"occurrences-{k}")
        _remove(spark, path)
        bits.unpersist()
        relation, path = longer, longer_path
        counts = relation.select("lefts", "rights", "counts").mapInArrow(_phrase_counts, "code long, n long")
        groups = stored(counts.groupBy("code").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), f"groups-{k}")
        bits = bitmap_filter(groups, "code", SLOTS)
        parts = _parts_of(relation, groups, bits)
        x = level.select(F.col("code").alias("left"), "lang", F.col("phrase").alias("head"))
        y = level.select(F.col("code").alias("right"), F.substring_index("phrase", " ", -1).alias("tail"))
        found = groups.join(parts, "code").join(x, "left").join(y, "right")
        level = stored(found.select("lang", F.lit(k).alias("k"), F.concat_ws(" ", "head", "tail").alias("phrase"), "f", "code", "left", "right"), f"phrases-{k}")
        every = every.unionByName(level)
    bits.unpersist()
    _remove(spark, path)
    return total, every


def score(a: str, n: str, l: str, r: str) -> str:
    """floor(1000 a n / (l r)) in decimals of 38 digits: exact up to 10^16 words."""
    whole = lambda x, digits: f"CAST({x} AS DECIMAL({digits},0))"
    return f"({whole(1000, 4)} * {whole(a, 16)} * {whole(n, 16)}) div ({whole(l, 18)} * {whole(r, 18)})"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two words or more of every language by how much more often
    their parts stand together than apart, at the cut where that is least."""
    total, every = frequent_phrases(docs, least, longest)
    candidates = every.filter("k > 1")
    # a phrase inside a longer one of equal count lies inside one that is a single word longer, of equal count as well
    around = candidates.select(F.explode(F.array("left", "right")).alias("code"), "f").groupBy("code").agg(F.max("f").alias("around"))
    own = candidates.select("lang", "k", "phrase", F.col("f").alias("a"), "code").join(around, "code", "left")
    own = stored(own.filter("around IS NULL OR around < a").drop("around"), "candidates")
    words = F.split("phrase", " ")
    cuts = own.select("lang", "phrase", "a", "code", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "code", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("rest"))
    parts = every.select("lang", "phrase", "f")
    x = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    y = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(x, ["lang", "first"]).join(y, ["lang", "rest"]).join(total, "lang")
    scored = cuts.select("lang", "phrase", "a", "n", F.struct(F.expr(score("a", "n", "l", "r")).alias("score"), "cut", "l", "r").alias("c"))
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    ahead = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
