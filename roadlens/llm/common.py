"""Shared pieces of the corpus operators: words, scratch tables, sources, row keys.

Rules that hold for every operator of this subpackage
-----------------------------------------------------
* A null text counts as the empty text; such rows stay in the result unless the operator says
  otherwise.
* Input columns that an operator does not produce pass through; an input column whose name an
  operator does produce is replaced by the operator's.  Names that start with ``__`` are reserved.
* Rows that repeat (same id, same text) are separate rows, and each gets the same answer.
* An empty table gives an empty table with the full schema.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(col: str = "text") -> Column:
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder of the session (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage is cut, a lost
    executor rereads files, and later steps prune columns of a columnar table."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of ``size`` at most for the jobs run inside: an executor holds some of them on both sides of each of its Python
    workers, and by default one may take tens of MB where rows are whole blocks."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def hash_unit(col: Column, seed: str) -> Column:
    """A repeatable number in [0, 1) from a seed and a column (32 bits of MD5)."""
    return hash_bits(F.concat(F.lit(seed + ":"), F.coalesce(col.cast("string"), F.lit("\u0000null"))), 8) / F.lit(4294967296.0)


def hash_bits(col: Column, hex_digits: int) -> Column:
    """The first hex digits of a string's MD5 as a long (15 at most, so that it stays positive)."""
    return F.conv(F.substring(F.md5(col), 1, hex_digits), 16, 10).cast("long")


#: Bits of a bitmap filter: 16 MB, whatever the data.
SLOTS = 1 << 27


def bitmap_filter(rows: DataFrame, column: str, slots: int = SLOTS):
    """A broadcast bitmap of the 64-bit hashes in ``column``: a Bloom filter with one hash, for semi-joins inside tasks that an exact
    step follows.  At most slots / 64 rows reach the driver; a full bitmap only filters nothing."""
    words = rows.selectExpr(f"int(shiftright(pmod(`{column}`, {slots}), 6)) AS w", f"shiftleft(1L, int(pmod(`{column}`, 64L))) AS b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(slots >> 6, np.uint64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be among those of the bitmap; none that is gets lost."""
    slots = hashes & np.uint64(64 * len(bits) - 1)
    return ((bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1)).astype(bool)
