"""Sharding by sampled splitters (DataFrame functions only).

Key samples are drawn with a chance in proportion to a record's size; the quantiles of the sample
are range boundaries; records are range-partitioned by them, and ranges that turn out overfull
are subdivided by a denser sample of their own.  The ranges carry a distributed running sum:
range totals give each range its offset, a window inside the range gives each record its place.
A record's shard is then the fortieth of all bytes in which it begins, so shard sizes differ by
one record at most, however good the sample was: splitters only spread the work.

The key is (hash of the text, doc_id): equal texts lie side by side, so groups of copies share a
shard unless a shard boundary falls among them, and a text that a third of all rows share is
still cut by id.  The law is ``bytes``.

Defined cases: a null text has size 16 and checksum 0, and sorts with the empty text; null ids
come last among equal texts; repeated rows follow one another; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import hash_bits, hash_unit, stored, whole_text

SHARDS = 40
OVERHEAD = 16
#: Ranges aimed at, sampled keys per range, how full a range may be against the mean, and
#: the rows below which a range is not worth subdividing.
RANGES = 128
MAX_RANGES = 2048
ROWS_PER_RANGE = 1_000_000
PER_RANGE = 32
OVERFULL = 3.0
LEAST_ROWS = 1024
ROUNDS = 4
#: Stands for a null id in the key (after all others).
LAST_ID = (1 << 63) - 1


def record_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, id): all that sharding needs of a record, without its text."""
    t = whole_text()
    return docs.select(
        "doc_id",
        (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        hash_bits(t, 15).alias("__key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"),
    )


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below a record's key, by a binary search written as nested CASEs."""

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        key, ident = splitters[mid]
        below = f"__key < {key}L OR (__key = {key}L AND __id < {ident}L)"
        return f"CASE WHEN {below} THEN {search(lo, mid)} ELSE {search(mid + 1, hi)} END"

    return F.expr(search(0, len(splitters)))


def _sample(records: DataFrame, step: float, seed: str) -> list[tuple[int, int]]:
    """Keys drawn with chance size/step (surely, if larger), sorted.  About bytes/step of them."""
    unit = hash_unit(F.concat_ws(":", "__key", "__id"), seed)
    rows = records.filter(unit * F.lit(float(step)) < F.col("size")).select("__key", "__id").distinct().collect()
    return sorted((r[0], r[1]) for r in rows)


def splitters(records: DataFrame, per_range: int = PER_RANGE) -> list[tuple[int, int]]:
    """Range boundaries, those that subdivide overfull ranges included.  The driver gets a sample of
    ``ranges * per_range`` keys on average and at most MAX_RANGES times that share in later rounds."""
    total, rows = records.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return []
    ranges = min(max(RANGES, rows // ROWS_PER_RANGE), MAX_RANGES)
    fair = total / ranges
    sample = _sample(records, fair / per_range, "shard-0")
    cuts = sorted(set(sample[per_range::per_range]))
    for n in range(1, ROUNDS + 1):
        sums = records.groupBy(_range_of(cuts).alias("r")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).filter((F.col("s") > OVERFULL * fair) & (F.col("n") > LEAST_ROWS)).collect()
        if not sums:
            break
        full = records.filter(_range_of(cuts).isin([x["r"] for x in sums]))
        more = _sample(full, fair / per_range, f"shard-{n}")
        finer = sorted({*cuts, *more[per_range // 2 :: per_range // 2]})
        if len(finer) == len(cuts):
            break
        cuts = finer
    return cuts


def range_shards(records: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """records (see ``record_sizes``; more columns may come along) + ``shard, slot``.

    One shuffle of the records, by range.  What is broadcast has one row per range or per shard."""
    ranged = records.withColumn("__range", _range_of(splitters(records)))
    totals = ranged.groupBy("__range").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    ahead = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        F.col("__range").alias("__r"),
        F.coalesce(F.sum("__bytes").over(ahead), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(W.partitionBy(F.lit(1))).alias("__total"),
    )
    inside = W.partitionBy("__range").orderBy("__key", "__id").rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.withColumn("__upto", F.sum("size").over(inside)).withColumn("__nth", F.row_number().over(W.partitionBy("__range").orderBy("__key", "__id")))
    placed = placed.join(F.broadcast(totals), F.col("__range") == F.col("__r"))
    shard = F.expr(f"CAST(CAST(__bytes_before + __upto - size AS DECIMAL(28, 0)) * {int(n_shards)} DIV __total AS INT)")
    placed = placed.withColumn("shard", shard).withColumn("__row", F.col("__rows_before") + F.col("__nth"))
    placed = stored(placed.drop("__range", "__r", "__upto", "__nth", "__bytes_before", "__rows_before", "__total"), "placed")
    first = placed.groupBy(F.col("shard").alias("__s")).agg(F.min("__row").alias("__first"))
    placed = placed.join(F.broadcast(first), F.col("shard") == F.col("__s"))
    return placed.withColumn("slot", F.col("__row") - F.col("__first")).drop("__row", "__s", "__first")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every document."""
    records = stored(record_sizes(docs), "records")
    placed = range_shards(records, n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """The documents themselves as Parquet folders ``shard=<n>``, each in slot order.  Rows are carried whole
    through the one range shuffle."""
    columns = docs.columns
    t = whole_text()
    records = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"),
        (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        hash_bits(t, 15).alias("__key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__id"),
    )
    placed = range_shards(records, n_shards).select(F.col("__doc.*"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    placed.repartition(n_shards, "__shard").sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)
