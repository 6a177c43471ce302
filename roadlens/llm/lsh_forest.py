"""MinHash near-duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, full sets to confirm.

Two documents link when their sets of ``WIDTH``-word shingles have Jaccard similarity ``PERCENT``/100 or more.

1. *Signatures.*  Each text gets ``TREES`` labels of ``DEPTH`` MinHash values.  Texts of equal sets are one class (a 128-bit
   digest names it), so exact copies are compared with nothing.
2. *Regions.*  In every tree the classes that agree in their first ``LEAST_DEPTH`` values are a region.  Its depth is adaptive:
   a region of more than ``REGION`` classes is cut by the next value, and so on; classes of equal labels are cut by a hash.
   So no sort sees more than some ``REGION`` classes of one region.
3. *Neighbours.*  Regions are sorted by label; next to a class stands one with the longest common prefix.  Of its
   neighbours in all trees a class takes the one met most often (then: of the longest prefix) and confirms the link on the full sets.
4. *Ascent.*  Regions whose classes are one component now are done.  Those that are still split go back up to
   ``LEAST_DEPTH``: classes that hang together by split regions are compared with each other on their full sets, in tiles inside
   tasks, so no pairs become rows and nothing is capped.

A pair is found if one tree has it in one region: at similarity 0.85 all but (1 - 0.85^5)^24 = 8e-7 of the pairs, fewer
missed above.  Every link is confirmed on full sets, so none is false (64-bit shingle hashes).

Texts are read twice: once for the signatures, once for the sets of those classes that share a region.

Defined cases: a text without words (or null) has an empty set and is a component of its own; fewer words than ``WIDTH`` are one
shingle; rows that repeat are separate rows with equal answers; a row without an id takes the least id of its group (null if none).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import bitmap_filter, in_bitmap, stored, whole_text
from .jaccard_join import Shingler, _spanning

WIDTH = 3
PERCENT = 85
TREES = 24
DEPTH = 8
LEAST_DEPTH = 5
#: Classes that one sort of a region may hold.
REGION = 512
#: Classes and shingles of one block of a tile.
TILE_CLASSES = 512
TILE_SHINGLES = 1_000_000
_VALUE = 2
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) | 1 for k in range(TREES * DEPTH)], np.uint64)
_SHIFT = np.array([pow(0xD6E8FEB86659FD93, k + 2, 1 << 64) for k in range(TREES * DEPTH)], np.uint64)

_SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType()),
    T.StructField("cid", T.BinaryType()), T.StructField("sig", T.BinaryType()),
])
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("cid", pa.binary()), ("sig", pa.binary())])
_SETS = T.StructType([T.StructField("cid", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
_SETS_ARROW = pa.schema([("cid", pa.binary()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])
_LINK = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
_LINK_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of 64-bit hashes, 16 bits each, tree by tree."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[k : k + 1024, None] * _ODD + _SHIFT).min(axis=0))
    least ^= least >> np.uint64(32)
    return ((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype("<u2")


def _text(cell) -> bytes:
    return cell.as_buffer().to_pybytes() if cell.is_valid else b""


def _sign(width: int):
    def run(batches):
        shingle = Shingler(width)
        for batch in batches:
            sizes, cids, sigs = [], [], []
            for text in batch.column(2):
                s = shingle(_text(text))
                sizes.append(len(s))
                cids.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sigs.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(cids, pa.binary()), pa.array(sigs, pa.binary())], schema=_SIGNED_ARROW)

    return run


def _full_sets(width: int, bits):
    """(key, text) -> the classes and full sets of the texts whose key the bitmap has."""

    def run(batches):
        shingle = Shingler(width)
        for batch in batches:
            chosen = np.flatnonzero(in_bitmap(bits.value, batch.column(0).to_numpy().view(np.uint64)))
            sets = [shingle(_text(batch.column(1)[k])) for k in chosen.tolist()]
            sets = [s for s in sets if len(s)]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64)))
            cids = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([cids, pa.array(np.diff(ends), pa.int32()), lists], schema=_SETS_ARROW)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key names a row by its id and text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, whole_text()).alias("key"), whole_text().cast("binary").alias("text"))


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Step 1: (doc_id, key, size, cid, sig) of every row; cid and sig are null for empty sets."""
    return stored(_keyed(docs).mapInArrow(_sign(width), _SIGNED), "signatures")


def regions(classes: DataFrame) -> DataFrame:
    """Step 2: (key, region, label, cid): the places of the classes in the trees where they are not alone.  ``key`` names the region
    at LEAST_DEPTH, ``region`` the one at its adaptive depth."""
    prefix = lambda d: F.substring("label", 1, _VALUE * d)
    span = _VALUE * DEPTH
    places = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    places = places.select("cid", "tree", F.col("sig").substr(F.col("tree") * span + 1, F.lit(span)).alias("label"))
    places = stored(places.select(F.xxhash64("tree", prefix(LEAST_DEPTH)).alias("key"), "label", "cid"), "places")
    shared = stored(places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "regions")
    # sort-merged at every size: both sides grow with the corpus
    places = stored(places.join(shared.hint("merge"), "key"), "shared-places")
    done = places.filter(F.col("n") <= REGION).select("key", F.col("key").alias("region"), "label", "cid")
    open_ = places.filter(F.col("n") > REGION).drop("n")
    for depth in range(LEAST_DEPTH + 1, DEPTH + 1):
        if open_.isEmpty():
            return done
        open_ = open_.withColumn("region", F.xxhash64("key", prefix(depth)))
        counts = open_.groupBy("region").agg(F.count("*").alias("n"))
        open_ = stored(open_.join(counts, "region"), f"depth-{depth}")
        done = done.unionByName(open_.filter(F.col("n") <= REGION).select(*done.columns))
        last = open_.filter(F.col("n") > REGION)
        open_ = last.drop("n", "region")
    parts = F.ceil(F.col("n") / REGION).cast("long")
    return done.unionByName(last.select("key", F.xxhash64("region", F.pmod(F.xxhash64("cid"), parts)).alias("region"), "label", "cid"))


def neighbours(places: DataFrame) -> DataFrame:
    """Step 3: (a, b): each class with the neighbour that it meets in most trees, then by the longest common prefix."""
    order = Window.partitionBy("region").orderBy("label", "cid")
    pairs = places.select(F.col("cid").alias("x"), F.lag("cid").over(order).alias("y"), "label", F.lag("label").over(order).alias("before")).filter("y IS NOT NULL")
    common = sum(F.when(F.substring("label", 1, _VALUE * d) == F.substring("before", 1, _VALUE * d), 1).otherwise(0) for d in range(1, DEPTH + 1))
    met = pairs.groupBy("x", "y").agg(F.count("*").alias("n"), F.max(common).alias("lcp"))
    both = met.select("x", "y", "n", "lcp").unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y"), "n", "lcp"))
    both = both.groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("lcp").alias("lcp"))
    best = both.groupBy("x").agg(F.max_by("y", F.struct("n", "lcp", F.xxhash64("y"))).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("cid").alias("a"), F.col("size").alias("sa"), F.col("shingles").alias("xa"))
    y = sets.select(F.col("cid").alias("b"), F.col("size").alias("sb"), F.col("shingles").alias("xb"))
    alike = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")
    common = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").filter(alike).filter(100 * common >= percent * (F.col("sa") + F.col("sb") - common)).select("a", "b")


def _tile_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside groups (cid, grp): blocks of classes against blocks, inside tasks; only links that span the components of a tile
    leave it."""
    held = groups.join(sets, "cid")
    per = held.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    per = per.select("grp", F.greatest(F.ceil(F.col("n") / TILE_CLASSES), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int").alias("n_blocks"), "total")
    per = stored(per.filter("n_blocks > 0"), "groups")
    work = per.agg(F.sum(F.col("total") * F.col("n_blocks"))).first()[0] or 0
    n_tasks = max(1, math.ceil(work / (2 * TILE_SHINGLES)))
    tiles = held.join(per.select("grp", "n_blocks"), "grp").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tiles = tiles.withColumn("tile", F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")))
    tiles = tiles.select(F.pmod("tile", F.lit(n_tasks)).alias("task"), "tile", "block", "cid", "size", "shingles")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = []
        tile = table.column("tile").to_numpy()
        order = np.argsort(tile, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            part = table.take(pa.array(rows)).combine_chunks()
            if len(rows) > 1:
                sets_ = [x.values.to_numpy() for x in part.column("shingles").combine_chunks()]
                out += _spanning(part.column("cid").to_pylist(), part.column("size").to_numpy(), part.column("block").to_numpy(), sets_, percent)
        return pa.Table.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], schema=_LINK_ARROW)

    return tiles.groupBy("task").applyInArrow(compare, _LINK)


def links(docs: DataFrame, signed: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Steps 2 to 4: links (a, b) between classes whose components are those of all links found."""
    classes = signed.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("key").alias("key"), F.min("sig").alias("sig"))
    classes = stored(classes, "classes")
    places = stored(regions(classes.select("cid", "sig")), "shared")
    wanted = stored(classes.select("cid", "key").join(places.select("cid").distinct().hint("merge"), "cid", "left_semi"), "wanted")
    # one row of each class is read again: a bitmap of their keys keeps the other texts from moving
    bits = bitmap_filter(wanted, "key")
    sets = _keyed(docs).select("key", "text").mapInArrow(_full_sets(width, bits), _SETS)
    # rows that repeat, and the few that the bitmap lets through, are classes too: one row of each
    sets = stored(sets.groupBy("cid").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")), "sets")
    bits.unpersist()
    near = stored(confirmed(stored(neighbours(places), "neighbours"), sets, percent), "near")
    component = connected_components(wanted.select("cid"), near, "cid", "a", "b").withColumnRenamed("component", "comp")
    met = places.select("key", "cid").join(component, "cid")
    split = met.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.min("cid").alias("first")).filter("p < q")
    met = stored(met.join(split.select("key", "first"), "key").select("cid", "first").distinct(), "split")
    grouped = connected_components(met.select("cid").distinct(), met.filter("cid <> first"), "cid", "cid", "first").withColumnRenamed("component", "grp")
    return stored(near.unionByName(_tile_links(stored(grouped, "hang-together"), sets, percent)), "links")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    signed = signatures(docs, width)
    linked = links(docs, signed, width, percent)
    ends = linked.select(F.col("a").alias("id")).unionByName(linked.select(F.col("b").alias("id"))).distinct()
    component = connected_components(ends, linked, "id", "a", "b")
    rows = signed.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "cid")
    least = rows.filter("cid IS NOT NULL").groupBy(F.col("cid").alias("id")).agg(F.min("doc_id").alias("least"))
    least = least.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = least.groupBy("component").agg(F.min("least").alias("named"))
    named = least.join(named, "component").select("id", "named")
    out = rows.join(named, F.col("cid") == F.col("id"), "left")
    component_id = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("named")).alias("component_id")
    return out.select("doc_id", "n_shingles", component_id).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
