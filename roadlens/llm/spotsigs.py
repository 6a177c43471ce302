"""Document fingerprints by SpotSigs.

A spot signature is an anchor (a very common word) with the chain of the next ``CHAIN`` content
words after it, so a fingerprint rests on running prose and not on menus and lists.  A fingerprint
is the set of a text's signatures, written as its sorted 32-bit hashes in hex.  Sets are partitioned
by length such that sets of ``PERCENT`` likeness lie in the same or in neighbouring partitions; the
comparison of two sets stops as soon as their lengths, or what is left of them, exclude the
likeness asked for.

Defined cases: null text counts as empty; a text without a word has the empty fingerprint; a text with
words but no complete chain has one signature, of all its words; two empty fingerprints are alike
(1.0), an empty and a full one are not (0.0); equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text
from .hashed_text import normal
from .jaccard_join import near_duplicate_groups

CHAIN = 2
PERCENT = 75
#: Bytes of text that one block of neighbours is aimed at.
BLOCK_BYTES = 16 << 20
REMEMBERED = 500_000
LAST_ID = (1 << 63) - 1

#: Very common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
    a an and are as at be by for from had have he her his in is it not of on or that the they this to was were which with you
    als am auf aus bei das dem den der des die ein eine einer es für hat ich im ist mit nach nicht sich sie sind um und von war wie wird zu zum
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sur un une vous
    al como con del el ella en entre era es esta está ha hay la las lo los más me muy no o para pero por que se si sin sobre su sus también un una y ya
    """.split()
)


class SpotSets:
    """Text -> sorted distinct signatures (uint64; the low 32 bits are the signature)."""

    def __init__(self, chain: int = CHAIN):
        self.chain = chain
        self.known: dict[str, int] = {}
        self.odd = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1) for k in range(chain + 1)]

    def _code(self, word: str) -> int:
        """Hash of a word: even for content, odd for an anchor, 0 for a mark."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        plain = normal(word)
        code = 0 if not plain else (xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1) - (plain not in ANCHORS)
        self.known[word] = code
        return code

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        get, make = self.known.get, self._code
        codes = np.fromiter([make(w) if (c := get(w)) is None else c for w in words], np.uint64, len(words))
        codes = codes[codes != 0]
        if not len(codes):
            return np.empty(0, np.uint64)
        anchor = codes & np.uint64(1) == 1
        content = codes[~anchor]
        spots = np.flatnonzero(anchor)
        first = spots - np.arange(len(spots))  # content words before the anchor
        whole = first + self.chain <= len(content)
        spots, first = spots[whole], first[whole]
        if not len(spots):
            return np.array([xxhash.xxh32_intdigest(codes.tobytes())], np.uint64)
        mixed = codes[spots] * self.odd[0]
        for k in range(self.chain):
            mixed ^= mixed >> np.uint64(31)
            mixed = (mixed + content[first + k]) * self.odd[k + 1]
        mixed ^= mixed >> np.uint64(33)
        return np.unique(mixed & np.uint64(0xFFFFFFFF))


def as_text(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def length_partition(n: int, percent: int = PERCENT) -> int:
    """Sets whose likeness reaches ``percent`` lie in the same or in neighbouring partitions."""
    return -1 if n == 0 else int(math.log(n) / math.log(100 / percent) + 1e-9)


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0.0 as soon as it must be below ``least``.  Pruned by length first, then by halves: what
    the lower halves have in common plus all of the smaller upper half bounds the intersection."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if least and (abs(length_partition(len(a)) - length_partition(len(b))) > 1 and least * 100 >= PERCENT or min(len(a), len(b)) < least * max(len(a), len(b))):
        return 0.0
    total = len(a) + len(b)
    if least:
        pivot = a[len(a) // 2]
        i, j = len(a) // 2, int(np.searchsorted(b, pivot))
        common = len(np.intersect1d(a[:i], b[:j], assume_unique=True))
        most = common + min(len(a) - i, len(b) - j)
        if most < least * (total - most):
            return 0.0
        common += len(np.intersect1d(a[i:], b[j:], assume_unique=True))
    else:
        common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (total - common)


def fingerprint(text: str = "text") -> Column:
    """The fingerprint of a text column (hex string)."""

    def prints(texts: pa.Array) -> pa.Array:
        spots = SpotSets()
        return pa.array([as_text(spots(t)) for t in texts.to_pylist()], pa.string())

    prints.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(prints, T.StringType())(whole_text(text))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) as in ``near_duplicate_groups``, with spot signatures as the sets: classes of equal
    fingerprints meet by their rarest signatures within a partition of set length and its neighbour."""
    return near_duplicate_groups(docs, percent=percent, sets=_spot_bytes, by_length=True)


def _spot_bytes():
    spots = SpotSets()
    spread = np.uint64(0x9E3779B97F4A7C15)
    return lambda text: np.unique(spots(text.decode("utf-8", "replace")) * spread)


# --- comparison with the next document ----------------------------------------------------------

_EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
    T.StructField("n_signatures", T.IntegerType()),
    T.StructField("length_partition", T.IntegerType()),
])


def _neighbours(batches):
    """Rows sorted by (block, after, id): each document is compared with the row behind it in its block.  Rows
    marked as guests are there to be compared with only.  One row is held at a time."""
    spots = SpotSets()
    held = None  # (block, doc_id, text, set) of a document that waits for the next one
    for batch in batches:
        rows = []
        for block, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("__block", "__guest", "doc_id", "text"))):
            own = spots(text)
            if held is not None and held[0] == block:
                rows.append(_compare(spots, *held[1:], text, own))
            held = None if guest else (block, doc_id, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _EDITED_ARROW.types)], schema=_EDITED_ARROW)


_EDITED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int32()), ("length_partition", pa.int32()),
])


def _compare(spots, doc_id, text, own, next_text, next_set):
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    edited_set = spots(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (
        doc_id, len(text), digest, as_text(own), as_text(edited_set), pruned_jaccard(own, edited_set), pruned_jaccard(own, next_set),
        len(own), length_partition(len(own)),
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's (ascending id, null ids last, repeated
    ids in order of text; after the last comes the first).

    The texts are shuffled once, by range of id.  Range bounds are ids of documents, so the one document
    that a block's last one needs is known beforehand and is sent to both blocks."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ident.alias("__id"), whole_text().alias("text"))
    first, size = rows.agg(F.min("__id"), F.sum(F.octet_length("text"))).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(math.ceil((size or 0) / BLOCK_BYTES), 2 * parts)
    cuts = []
    if n_blocks > 1:
        fractions = [k / n_blocks for k in range(1, n_blocks)]
        cuts = sorted(set(rows.agg(F.percentile_approx("__id", fractions, 100 * n_blocks)).first()[0] or []) - {first})
    bounds = np.array(cuts, np.int64)
    last = len(bounds)

    def blocks(ids: pa.Array) -> pa.Array:
        at = np.asarray(ids)
        own = np.searchsorted(bounds, at, side="right")
        opens = np.isin(at, bounds)
        places = [[(b, False, False)] + ([(b - 1, True, False)] if o else []) + ([(last, True, True)] if i == first else []) for b, o, i in zip(own.tolist(), opens.tolist(), at.tolist())]
        return pa.array([[{"block": b, "guest": g, "after": a} for b, g, a in p] for p in places], _PLACES_ARROW)

    blocks.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    placed = rows.withColumn("__p", F.explode(F.arrow_udf(blocks, _PLACES)(F.col("__id"))))
    placed = placed.select(F.col("__p.block").alias("__block"), F.col("__p.guest").alias("__guest"), F.col("__p.after").alias("__after"), "__id", "doc_id", "text")
    placed = placed.repartition(max(last // 2 + 1, parts), "__block").sortWithinPartitions("__block", "__after", "__id", "text")
    return placed.select("__block", "__guest", "doc_id", "text").mapInArrow(_neighbours, _EDITED)


_PLACES = T.ArrayType(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("after", T.BooleanType())]))
_PLACES_ARROW = pa.list_(pa.struct([("block", pa.int32()), ("guest", pa.bool_()), ("after", pa.bool_())]))
