"""A training corpus from ``documents``: quality rules, line dedup, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result
is written as Parquet and reread.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import jaccard_join, line_dedup, mixing, quality_rules
from roadlens.llm.common import WORD, stored, table
from roadlens.llm.queries import tokenizer


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB: an executor holds some of them on both sides of each of its Python workers, which live on from stage to
    stage."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of policy v1.  A null or empty text has too few words and goes; rows that repeat are judged alike;
    an empty table stays empty; all columns pass through, also those named like a measure."""
    _small_batches(spark)
    return quality_rules.ledger(docs).filter(quality_rules.passes("v1")).select(_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks and passages of lines that the corpus has at an earlier place.  A document that loses all its
    words (a copy, as a rule) goes.  A null or blank text loses nothing and stays; rows equal in id and text lose the same;
    an empty table stays empty; other columns pass through, save ``n_chars``, which follows the text."""
    # kept before it is filtered: a filter on the text would be pushed below, and evaluate the rebuilding of texts anew
    clean = stored(line_dedup.dedup_lines(docs), "clean-lines")
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(WORD)
    clean = clean.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, told apart by text where ids repeat.  Rows without an id
    come last in their group; rows equal in id and text stay or go together; texts without words, or null, stay; an empty table
    stays empty; all columns pass through."""
    _small_batches(spark)
    return jaccard_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target weights.  A null source is a source; texts without words have
    size 0 and cost nothing; ties are broken by a hash of the id; an empty table stays empty; all columns pass through."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and whether they decode to its text.  A null text is empty: no ids; rows that repeat are encoded
    alike; an empty table gives an empty one."""
    _small_batches(spark)
    tok = tokenizer(spark)
    encoded = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), tok.round_trip().alias("e"))
    exact = (F.col("e.decoded") == F.col("bytes")).alias("round_trip")
    return encoded.select("doc_id", "source", "lang", F.size("e.ids").cast("long").alias("n_tokens"), F.col("e.ids").alias("ids"), exact)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("mix_sources", mixed),
    ("byte_bpe", tokens),
]

#: Byte-pair merges cannot be stated in SQL; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
