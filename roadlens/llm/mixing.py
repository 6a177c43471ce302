"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source is expected ``target / source_size`` times.  Along a fixed order of
the source's documents these expectations are added up, one random offset is added, and a
document is emitted once for every whole number that its stretch of the sum crosses.  The order
is by size, so the documents taken have the source's own spread of sizes and the words taken
come close to the target (they miss it by about one long document at most).

Scale: a source may hold any share of the rows.  Its rows are dealt into blocks (size class,
hash of the id); ranks inside a block come from a window over that block, block offsets from the
small table of block counts (a bounded number of blocks per source).  No text is shuffled unless
``mix`` is asked to carry it.

Defined cases: null text has size 0; the null source is a source of its own and comes last; a
source without words has target 0; documents of size 0 in a source with words are dealt like
the others (and take nothing); repeated rows are dealt separately; ties in size are ordered by
hash, id, then by nothing that matters (equal rows are interchangeable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import hash_bits, hash_unit, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
#: Blocks per size class of a source.
SPREAD = 256
SEED = "mix-1"


def weight_of(rank: Column) -> Column:
    """Sources in order of code point, null last, weigh 5, 2, 1, 5, 2, 1 ..."""
    out = F.lit(WEIGHTS[-1])
    for i in range(len(WEIGHTS) - 1):
        out = F.when(rank % len(WEIGHTS) == i, F.lit(WEIGHTS[i])).otherwise(out)
    return out


def source_targets(sizes: DataFrame, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size) rows -> (source, source_size, target).

    Targets share ``share`` of all sizes by weight; none exceeds ``max_repeat`` times its source's
    size.  Sources are filled in the order in which they reach their cap: the level (target per
    weight) left over for a source and those after it is compared with its own cap per weight.
    The windows run over one row per source; sources are a configuration, not data."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("__rank", rank).withColumn("__weight", weight_of(F.col("__rank")))
    per = per.withColumn("__cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("__full", F.col("__cap") / F.col("__weight"))
    order = W.orderBy("__full", "__rank")
    capped_before = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("__weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    per = per.withColumn("__level", (everything * F.lit(float(share)) - capped_before) / weight_left)
    # the level of the first source below its cap holds for all that follow
    open_level = F.when(F.col("__level") <= F.col("__full"), F.col("__level"))
    level = F.first(open_level, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("__at", level).select(
        "source", "source_size", F.when(F.col("__at").isNull(), F.col("__cap")).otherwise(F.col("__at") * F.col("__weight")).alias("target")
    )


def size_class(size: Column) -> Column:
    """Order-keeping class of a size: its bit length and its four leading bits."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).cast("int")


def copies_plan(docs: DataFrame, seed: str = SEED, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """docs with ``doc_id, source, size`` -> docs + ``source_size, target, copies``."""
    replaced = {"source_size", "target", "copies"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in replaced])
    docs = docs.withColumn("__class", size_class(F.col("size"))).withColumn("__spread", (hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8) % SPREAD).cast("int"))
    blocks = docs.groupBy("source", "__class", "__spread").agg(F.count("*").alias("__rows"), F.sum("size").alias("size"))
    blocks = stored(blocks, "mix-blocks")
    targets = source_targets(blocks, share, max_repeat)
    ahead = W.partitionBy("source").orderBy("__class", "__spread").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__ahead", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)))
    t = targets.select(F.col("source").alias("__ts"), "source_size", "target")
    blocks = blocks.join(t, F.col("source").eqNullSafe(F.col("__ts"))).select(
        F.col("source").alias("__bs"), F.col("__class").alias("__bc"), F.col("__spread").alias("__bh"), "__ahead", "source_size", "target"
    )
    inside = W.partitionBy("source", "__class", "__spread").orderBy("size", F.col("doc_id").asc_nulls_last())
    ranked = docs.withColumn("__rank", F.row_number().over(inside))
    ranked = ranked.join(blocks, F.col("source").eqNullSafe(F.col("__bs")) & (F.col("__class") == F.col("__bc")) & (F.col("__spread") == F.col("__bh")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hash_unit(F.col("source"), seed)
    upto = F.col("__ahead") + F.col("__rank")
    copies = (F.floor(rate * upto + offset) - F.floor(rate * (upto - 1) + offset)).cast("long")
    return ranked.withColumn("copies", copies).drop("__class", "__spread", "__rank", "__bs", "__bc", "__bh", "__ahead")


def mix(docs: DataFrame, seed: str = SEED, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the plan says (0, 1, 2 ... times), with
    the columns of ``docs``."""
    columns = docs.columns
    # the caller's columns travel under one name, so none can clash with the plan's
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), "doc_id", "source", word_count().alias("size"))
    plan = copies_plan(sized, seed, share, max_repeat).filter("copies > 0")
    return plan.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
