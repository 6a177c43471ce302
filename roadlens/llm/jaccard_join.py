"""N-gram Jaccard self-join: size-aware heavy-light, exact, without pairs of copies.

Two documents link when their sets of word n-grams have Jaccard similarity ``PERCENT``/100 or more.

1. *Sets.*  Each task turns its texts into sets of 64-bit shingle hashes.  Equal sets are one class
   (named by an 80-bit digest), so exact copies are compared with nothing.
2. *Frequencies.*  The shingles of all classes are dealt out by hash range as packed blocks; each
   range counts in how many classes every shingle occurs and gives back those that occur in two
   or more.  A shingle of one class only can link nothing.
3. *Prefixes.*  Under the order "rare first", two linked sets of size s share a shingle among their
   first s - ceil(0.75 s) + 1 (and two shingles among one more).  A class whose prefix is made of
   its own shingles is done; in practice only near copies go on, and passages that very many
   documents share lie behind the prefix.
4. *Heavy and light.*  Small sets enumerate all pairs of shingles of their prefix and meet in the
   buckets of these pairs; a set above the size boundary scans the inverted lists of its single prefix
   shingles (small sets that its size can match are posted there too).  The boundary is the one
   of least cost, from the sizes and list lengths of the classes at hand.
5. *Links.*  Classes that hang together by shared buckets form a group.  A group is compared within itself in tiles
   (blocks of classes against blocks), inside tasks, and only links that span components leave a task, so
   no pairs of a bucket become rows.  In a large group every class is first compared with one leader
   and only buckets that are still split go on; a large group that is sparse, so that its buckets hold few
   pairs for its size, is joined bucket by bucket instead.

No shingle, list or candidate is capped.  The classes, posts and links stay in Spark; the driver
sees counts.  Memory: about ``BLOCK`` shingles per task.

Defined cases: null texts and texts without a word have an empty set, n_shingles 0 and are their
own component; a text with fewer words than n is one shingle; repeated rows are members of one
class; null ids never name a component unless it has no other id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import stored, whole_text

WIDTH = 5
PERCENT = 75
#: Shingles that a task gathers before it deals them out, and that one range is aimed at.
CHUNK = 250_000
BLOCK = 4_000_000
#: Words whose hash a worker remembers.
REMEMBERED = 100_000
SUBSET = 2
#: Classes and shingles of a block of a large group, shingles multiplied at once, and the cost of comparing a pair
#: in a tile against that of a row of the pair join.
TILE_ROWS = 512
TILE_SHINGLES = 1_000_000
TILE_COLUMNS = 4096
TILE_COST = 0.05
#: Cost of comparing with an entry of an inverted list, against that of posting a row: lists are compared in tiles,
#: by matrix products.
SCAN_COST = 0.002



class Shingler:
    """UTF-8 text -> sorted distinct 64-bit hashes of its shingles."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}
        self.odd = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(width)]

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        get, make = self.known.get, self._hash
        codes = np.fromiter([get(w) or make(w) for w in words], np.uint64, len(words))
        width = min(self.width, len(codes))
        n = len(codes) - width + 1
        mixed = np.full(n, width, np.uint64)
        for k in range(width):
            mixed += codes[k : k + n] * self.odd[k]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


_BLOCK_ROW = T.StructType([
    T.StructField("bucket", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.LongType())),  # of a block of documents; null in a block of shingles
    T.StructField("texts", T.BinaryType()),  # hashes of their texts
    T.StructField("digests", T.BinaryType()),
    T.StructField("sizes", T.BinaryType()),
    T.StructField("counts", T.BinaryType()),
    T.StructField("shingles", T.BinaryType()),
])
_FOUND_ROW = T.StructType([
    T.StructField("is_doc", T.BooleanType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("th", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("size", T.IntegerType()),
    # a block of classes: where it goes, the range it comes from, and the shingles that other classes have too
    T.StructField("dest", T.IntegerType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("digests", T.BinaryType()),
    T.StructField("sizes", T.BinaryType()),
    T.StructField("counts", T.BinaryType()),
    T.StructField("shared", T.BinaryType()),
])
_BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("texts", pa.binary()), ("digests", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("shingles", pa.binary())])
_FOUND_ARROW = pa.schema([
    ("is_doc", pa.bool_()), ("doc_id", pa.int64()), ("th", pa.int64()), ("digest", pa.binary()), ("size", pa.int32()), ("dest", pa.int32()), ("bucket", pa.int32()),
    ("digests", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("shared", pa.binary()),
])
#: Bytes of a class's digest, of a shingle within its range, and of a frequency (which stops at its largest value; it
#: only orders).
_DIGEST, _KEY, _FREQ = 10, 5, 2
#: Shingles of one entry of a block; a class with more in one range has several entries.
_MOST = (1 << 16) - 1
_SHARED = _KEY + _FREQ


def _entries(members, counts):
    """Members with their counts, cut into entries of _MOST at most."""
    pieces = -(-counts // _MOST)
    members = np.repeat(members, pieces)
    out = np.full(len(members), _MOST, np.int64)
    out[np.cumsum(pieces) - 1] = counts - (pieces - 1) * _MOST
    return members, out


def _blocks(ids, texts, sets, digests, n_buckets, turn):
    """Packed rows of one chunk of documents: their digests, and the shingles of each class by range."""
    sizes = np.array([len(s) for s in sets], np.int32)
    rows = [((turn % n_buckets), ids, np.array(texts, "<i8").tobytes(), b"".join(digests), sizes.tobytes(), None, None)]
    classes = {d: i for i, d in enumerate(digests) if sizes[i]}
    first = list(classes.values())
    if first:
        every = np.empty(int(sizes[first].sum()), np.uint64)
        np.concatenate([sets[i] for i in first], out=every)
        sets.clear()
        bucket = ((every >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int32)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        bounds = np.searchsorted(bucket, np.arange(n_buckets + 1), sorter=order)
        del bucket
        owner = np.repeat(np.arange(len(first), dtype=np.int32), sizes[first])
        names = list(classes)
        for b in np.flatnonzero(np.diff(bounds)):
            here = order[bounds[b] : bounds[b + 1]]
            members, counts = _entries(*np.unique(owner[here], return_counts=True))
            packed = every[here].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY].tobytes()
            chosen = members.tolist()
            rows.append((int(b), None, None, b"".join([names[i] for i in chosen]), sizes[[first[i] for i in chosen]].tobytes(), counts.astype("<u2").tobytes(), packed))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK_ARROW.types)], schema=_BLOCK_ARROW)


def _pack(n_buckets: int, sets):
    def run(batches):
        shingle, turn, held = sets(), 0, 0
        ids, texts, made, digests = [], [], [], []
        for batch in batches:
            for doc_id, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle(text.as_buffer().to_pybytes() if text.is_valid else b"")
                ids.append(doc_id)
                texts.append(th)
                made.append(s)
                digests.append(xxhash.xxh128_digest(s.tobytes())[:_DIGEST])
                held += len(s) + 8
                if held >= CHUNK:
                    yield _blocks(ids, texts, made, digests, n_buckets, turn + digests[0][0])
                    ids, texts, made, digests, held, turn = [], [], [], [], 0, turn + 1
        if ids:
            yield _blocks(ids, texts, made, digests, n_buckets, turn + digests[0][0])
        pa.default_memory_pool().release_unused()  # the worker lives on: what this task is done with goes back

    return run


def _widen(narrow: np.ndarray) -> np.ndarray:
    """Rows of little-endian bytes -> uint64."""
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, : narrow.shape[1]] = narrow
    return wide.reshape(-1).view("<u8")


def _rows(schema: pa.Schema, n: int, **columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _split(digests: bytes) -> list[bytes]:
    return [digests[k : k + _DIGEST] for k in range(0, len(digests), _DIGEST)]


def _count_range(key: tuple[pa.Scalar, ...], table: pa.Table, n_dests: int) -> pa.Table:
    """All blocks of one range of shingles -> its documents' rows, and blocks of classes with the shingles that others
    have too, dealt by digest."""
    out = []
    names, sizes, counts, packed, fresh = [], [], [], [], []
    seen: dict[bytes, int] = {}  # a class may come from many tasks: the first block that has it counts
    for at, row in enumerate(table.to_pylist()):
        digests = _split(row["digests"])
        if row["ids"] is not None:
            n = np.frombuffer(row["sizes"], np.int32).tolist()
            named = [d if k else None for d, k in zip(digests, n)]
            out.append(_rows(_FOUND_ARROW, len(n), is_doc=[True] * len(n), doc_id=row["ids"], th=np.frombuffer(row["texts"], "<i8"), digest=named, size=n))
        else:
            names += digests
            fresh += [seen.setdefault(d, at) == at for d in digests]
            sizes.append(np.frombuffer(row["sizes"], np.int32))
            counts.append(np.frombuffer(row["counts"], "<u2"))
            packed.append(np.frombuffer(row["shingles"], np.uint8).reshape(-1, _KEY))
    if names:
        sizes, counts, every = np.concatenate(sizes), np.concatenate(counts), _widen(np.concatenate(packed))
        del packed
        owner = np.repeat(np.arange(len(names), dtype=np.int32), counts)
        keep = np.array(fresh)[owner]
        every, owner = every[keep], owner[keep]
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        runs = np.diff(np.append(starts, len(every)))
        freq = np.repeat(np.minimum(runs, (1 << 8 * _FREQ) - 1), runs)
        again = freq > 1
        every, owner, freq = every[again], owner[again], freq[again]
        order = np.argsort(owner, kind="stable")
        every, owner, freq = every[order], owner[order], freq[order]
        both = np.hstack([every.view(np.uint8).reshape(-1, 8)[:, :_KEY], freq.astype("<u2").view(np.uint8).reshape(-1, _FREQ)])
        members, counts = _entries(*np.unique(owner, return_counts=True))
        dest = np.array([int.from_bytes(names[i][:4], "little") % n_dests for i in members.tolist()], np.int64)
        shingle_dest = np.repeat(dest, counts)
        for d in np.unique(dest).tolist():
            here = members[dest == d]
            out.append(_rows(
                _FOUND_ARROW, 1, is_doc=[False], dest=[d], bucket=[key[0].as_py()], digests=[b"".join([names[i] for i in here.tolist()])],
                sizes=[sizes[here].tobytes()], counts=[counts[dest == d].astype("<u2").tobytes()], shared=[both[shingle_dest == d].tobytes()],
            ))
    return pa.concat_tables(out) if out else _FOUND_ARROW.empty_table()


def shared_shingles(docs: DataFrame, sets) -> DataFrame:
    """Steps 1 and 2: a stored table of document rows (is_doc) and of class rows, see ``_FOUND_ROW``.  ``sets()`` makes a
    function from UTF-8 text to a sorted array of distinct 64-bit hashes, in each task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), whole_text().cast("binary").alias("text"))
    total, n = docs.agg(F.sum(F.octet_length(whole_text())), F.count("*")).first()
    n_buckets = min(max(1, math.ceil(((total or 0) / 6 + 8 * n) / BLOCK)), 1 << 15)
    packed = rows.mapInArrow(_pack(n_buckets, sets), _BLOCK_ROW)
    # one bucket is one task's work: as many partitions as buckets, at least
    parts = max(n_buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def count_range(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _count_range(key, table, n_buckets)

    return stored(packed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(count_range, _FOUND_ROW), "shingles")


_CLASS = T.StructType([
    T.StructField("cid", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("r1", T.IntegerType()), T.StructField("r2", T.IntegerType()),
    T.StructField("scan", T.LongType()), T.StructField("shared", T.ArrayType(T.LongType())),
])
_CLASS_ARROW = pa.schema([("cid", pa.binary()), ("size", pa.int32()), ("r1", pa.int32()), ("r2", pa.int32()), ("scan", pa.int64()), ("shared", pa.list_(pa.int64()))])


def _assemble(table: pa.Table, percent: int) -> pa.Table:
    """All blocks of some classes -> the classes that can link, with their shingles rarest first."""
    total: dict[bytes, int] = {}
    blocks = []
    for row in table.to_pylist():
        digests, counts = _split(row["digests"]), np.frombuffer(row["counts"], "<u2").tolist()
        blocks.append((row["bucket"], digests, np.frombuffer(row["sizes"], np.int32).tolist(), counts, np.frombuffer(row["shared"], np.uint8).reshape(-1, _SHARED)))
        for d, n in zip(digests, counts):
            total[d] = total.get(d, 0) + n
    parts: dict[bytes, list] = {}
    prefix: dict[bytes, tuple[int, int]] = {}
    for bucket, digests, sizes, counts, both in blocks:
        at = 0
        for d, size, n in zip(digests, sizes, counts):
            r1 = size - -(-size * percent // 100) + 1 - (size - total[d])
            if r1 > 0:
                prefix[d] = (size, r1)
                parts.setdefault(d, []).append((bucket, both[at : at + n]))
            at += n
    out = {c: [] for c in _CLASS_ARROW.names}
    for d, pieces in parts.items():
        size, r1 = prefix[d]
        key = np.concatenate([_widen(x[:, :_KEY]) + np.uint64(bucket << 8 * _KEY) for bucket, x in pieces])
        freq = np.concatenate([_widen(x[:, _KEY:]) for _, x in pieces])
        order = np.lexsort((key, freq))
        for c, v in zip(_CLASS_ARROW.names, (d, size, r1, min(r1 + SUBSET - 1, len(key)), int(freq[order[:r1]].sum()), key[order].astype(np.int64))):
            out[c].append(v)
    return _rows(_CLASS_ARROW, len(parts), **out)


def joinable_classes(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Step 3: (cid, size, r1, r2, scan, shared) of the classes that can link at all.  ``shared``: the shingles that
    other classes have too, rarest first; ``r1``, ``r2``: how many of them are in the prefix and in the
    prefix for pairs; ``scan``: summed list lengths of the former."""

    def assemble(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _assemble(table, percent)

    blocks = found.filter("NOT is_doc").select("dest", "bucket", "digests", "sizes", "counts", "shared")
    return stored(blocks.groupBy("dest").applyInArrow(assemble, _CLASS), "classes")


def size_boundary(classes: DataFrame, percent: int = PERCENT) -> int:
    """Step 4: the size up to which enumerating pairs of prefix shingles costs less than scanning lists.
    Sizes are summed in classes of powers of two (32 rows at most reach the driver)."""
    r1, r2 = F.col("r1").cast("double"), F.col("r2").cast("double")
    rows = classes.groupBy(F.ceil(F.log2(F.col("size"))).cast("int").alias("b")).agg(
        F.sum(r2 * (r2 - 1) / 2).alias("subsets"), F.sum(r1).alias("posts"), F.sum(F.col("scan").cast("double")).alias("scan")
    ).collect()
    by = {r["b"]: r for r in rows}
    best = None
    for b in range(0, max(by, default=0) + 1):
        light = [r for k, r in by.items() if k <= b]
        heavy = [r for k, r in by.items() if k > b]
        # small sets within reach of a large one's size are posted in the lists as well
        near = by[b]["posts"] if b in by and heavy else 0
        cost = sum(r["subsets"] for r in light) + near + sum(SCAN_COST * r["scan"] + r["posts"] for r in heavy)
        if best is None or cost < best[0]:
            best = (cost, 1 << b)
    return best[1] if best else 0


def posts(classes: DataFrame, boundary: int, percent: int = PERCENT, by_length: bool = False) -> DataFrame:
    """(bucket, cid, size): where a class meets others.  Buckets of one class are dropped.  ``by_length`` splits every
    bucket by partitions of set length, each class in its own and in the next one."""
    prefix = F.slice("shared", 1, F.col("r2"))
    by_pair = F.flatten(F.transform(prefix, lambda x, i: F.transform(F.slice(prefix, i + 2, F.col("r2")), lambda y: F.xxhash64(x, y))))
    small = classes.filter(F.col("size") <= boundary).select("cid", "size", F.explode(by_pair).alias("bucket"))
    reach = F.ceil(F.lit((boundary + 1) * percent / 100)).cast("int")
    large = classes.filter(F.col("size") >= reach).select("cid", "size", F.explode(F.slice("shared", 1, F.col("r1"))).alias("bucket"))
    every = small.select("bucket", "cid", "size").unionByName(large.select("bucket", "cid", "size"))
    if by_length:
        part = F.floor(F.log("size") / math.log(100 / percent) + F.lit(1e-9))
        every = every.withColumn("part", F.explode(F.array(part, part + 1))).select(F.xxhash64("bucket", "part").alias("bucket"), "cid", "size")
    every = stored(every, "posts")
    one = every.withColumn("h", F.xxhash64("cid"))
    crowded = one.groupBy("bucket").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("bucket")
    return every.join(crowded, "bucket", "left_semi")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by the exact size of their intersection.  ``b`` is the
    side with fewer different classes; only their sets move to meet those of ``a``."""
    pairs = stored(pairs, "pairs")  # of known size, so that Spark broadcasts few pairs and shuffles many
    few = stored(pairs.select(F.col("b").alias("cid")).distinct(), "leaders")
    x = classes.select(F.col("cid").alias("a"), F.col("size").alias("sa"), F.col("shared").alias("xa"))
    y = classes.join(few, "cid", "left_semi").select(F.col("cid").alias("b"), F.col("size").alias("sb"), F.col("shared").alias("xb"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.filter(100 * common >= percent * (F.col("sa") + F.col("sb") - common)).select("a", "b")


def _groups(met: DataFrame) -> DataFrame:
    """(cid, grp): classes that hang together by shared buckets; nothing outside a group can link into it."""
    first = met.groupBy("bucket").agg(F.min("cid").alias("first"))
    edges = met.join(first, "bucket").filter("cid <> first").select("cid", "first").distinct()
    return connected_components(met.select("cid").distinct(), edges, "cid", "cid", "first").withColumnRenamed("component", "grp")


def _leader_links(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links of each class with the one leader that it meets in most buckets: linear in posts."""
    leader = met.groupBy("bucket").agg(F.min_by(F.struct("cid", "size"), F.xxhash64("cid")).alias("l"))
    pairs = met.join(leader, "bucket").filter((F.col("l.cid") != F.col("cid")) & _alike(F.col("size"), F.col("l.size"), percent))
    times = pairs.groupBy(F.col("cid").alias("a"), F.col("l.cid").alias("b")).agg(F.count("*").alias("n"))
    return _verified(times.groupBy("a").agg(F.max_by("b", F.struct("n", F.xxhash64("b"))).alias("b")), classes, percent)


def _pair_links(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links of all pairs that share a bucket (``met`` with ``comp``) and are not in one component yet."""
    x, y = met.alias("x"), met.alias("y")
    pairs = x.join(y, F.col("x.bucket") == F.col("y.bucket"))
    pairs = pairs.filter((F.col("x.cid") < F.col("y.cid")) & (F.col("x.comp") != F.col("y.comp")) & _alike(F.col("x.size"), F.col("y.size"), percent))
    return _verified(pairs.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct(), classes, percent)


_LINK = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
_LINK_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _spanning(cids, sizes, blocks, sets, percent):
    """Links that span the components of all links between classes of a tile: within its one block, or between its two.
    Intersections come from products of 0/1 matrices, some thousand shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times[column] > 1
    owner, column = owner[twice], (np.cumsum(times > 1) - 1)[column[twice]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = blocks == blocks.min()
    right = ~left if (~left).any() else left
    common = np.zeros((int(left.sum()), int(right.sum())), np.float32)
    width = int((times > 1).sum())
    for at in range(0, width, TILE_COLUMNS):
        a, z = np.searchsorted(column, (at, at + TILE_COLUMNS))
        x = np.zeros((len(sets), min(TILE_COLUMNS, width - at)), np.float32)
        x[owner[a:z], column[a:z] - at] = 1
        common += x[left] @ x[right].T
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    linked = 100 * common >= percent * (sizes[rows][:, None] + sizes[columns] - common)
    root = list(range(len(sets)))
    out = []
    for i, j in np.argwhere(linked).tolist():
        i, j = int(rows[i]), int(columns[j])
        a, b = i, j
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[a] = b
            out.append((cids[i], cids[j]))
    return out


def _tile_links(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links within groups (cid, grp) by comparing all of a group with each other in tiles.  A group is cut into blocks of
    TILE_ROWS classes or TILE_SHINGLES shingles; a tile holds one or two blocks, a task some tiles.  What
    leaves a task are links that span the components of its tiles, fewer than it has classes."""
    held = members.join(classes.select("cid", "size", "shared"), "cid").select("grp", "cid", "size", "shared", F.size("shared").alias("n"))
    per = members.join(classes.select("cid", F.size("shared").alias("n")), "cid").groupBy("grp").agg(
        F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("n_blocks"), F.sum("n").alias("total"))
    per = stored(per, "groups")
    work = per.agg(F.sum(F.col("total") * F.col("n_blocks"))).first()[0] or 0
    n_tasks = max(1, math.ceil(work / (2 * TILE_SHINGLES)))
    block = F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int")
    tiles = held.join(per.select("grp", "n_blocks"), "grp").withColumn("block", block)
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tiles = tiles.withColumn("tile", F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")))
    tiles = tiles.select(F.pmod("tile", F.lit(n_tasks)).alias("task"), "tile", "block", "cid", "size", "shared")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = []
        tile = table.column("tile").to_numpy()
        order = np.argsort(tile, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            part = table.take(pa.array(rows)).combine_chunks()
            sets = [x.values.to_numpy() for x in part.column("shared").combine_chunks()]
            if len(sets) > 1:
                out += _spanning(part.column("cid").to_pylist(), part.column("size").to_numpy(), part.column("block").to_numpy(), sets, percent)
        return _rows(_LINK_ARROW, len(out), a=[x for x, _ in out], b=[y for _, y in out])

    return tiles.groupBy("task").applyInArrow(compare, _LINK)


def _alike(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def links(classes: DataFrame, percent: int = PERCENT, by_length: bool = False) -> DataFrame:
    """Step 5: links (a, b) between classes whose components are those of all links."""
    boundary = size_boundary(classes, percent)
    met = stored(posts(classes, boundary, percent, by_length), "met")
    grouped = stored(_groups(met), "candidates")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("g"))
    small, large = (grouped.join(sizes.filter(c), "grp", "left_semi") for c in (F.col("g") <= TILE_ROWS, F.col("g") > TILE_ROWS))
    large = stored(large, "large")
    if large.isEmpty():
        return stored(_tile_links(grouped, classes, percent), "links")
    # a group of many classes: join what hangs on leaders first, then look at the buckets that are still split
    met = stored(met.join(large.select("cid"), "cid", "left_semi"), "met-large")
    led = stored(_leader_links(met, classes, percent), "led")
    component = connected_components(large.select("cid"), led, "cid", "a", "b").withColumnRenamed("component", "comp")
    met = met.join(component, "cid")
    split = met.groupBy("bucket").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p < q").select("bucket")
    met = stored(met.join(split, "bucket", "left_semi"), "split")
    regrouped = stored(_groups(met), "candidates")
    met = met.join(regrouped, "cid")
    pairs = met.groupBy("grp", "bucket").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("rows"))
    cost = regrouped.groupBy("grp").agg(F.count("*").alias("g")).join(pairs, "grp")
    dense = (F.col("g") <= TILE_ROWS) | (F.col("rows") > TILE_COST * F.col("g") * (F.col("g") - 1) / 2)
    cost = stored(cost.select("grp", dense.alias("dense")), "cost")
    tiled = stored(small.unionByName(regrouped.join(cost.filter("dense"), "grp", "left_semi")), "tiled")
    paired = met.join(cost.filter("NOT dense"), "grp", "left_semi")
    every = led.unionByName(_tile_links(tiled, classes, percent)).unionByName(_pair_links(paired, classes, percent))
    return stored(every, "links")


def text_hash():
    return F.xxhash64(whole_text())


def labelled(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, sets=None, by_length: bool = False) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, first) for every row of docs: ``th`` is the hash of its text, ``first`` the struct
    (no_id, doc_id, th) of its group's first row, by id (rows without one come last) and text hash."""
    found = shared_shingles(docs, sets or (lambda: Shingler(width)))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    rows = found.filter("is_doc").select("doc_id", "th", F.col("size").cast("long").alias("n_shingles"), "digest")
    linked = links(joinable_classes(found, percent), percent, by_length)
    ends = linked.select(F.col("a").alias("id")).unionByName(linked.select(F.col("b").alias("id"))).distinct()
    component = connected_components(ends, linked, "id", "a", "b")
    per_class = rows.filter("digest IS NOT NULL").groupBy(F.col("digest").alias("id")).agg(F.min(row).alias("least"))
    per_class = per_class.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = per_class.groupBy("component").agg(F.min("least").alias("first"))
    named = per_class.join(named, "component").select("id", "first")
    out = rows.join(named, F.col("digest") == F.col("id"), "left").withColumn("first", F.coalesce("first", row))
    alone = F.col("digest").isNull()
    return out.select("doc_id", "th", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "first")


def near_duplicate_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, sets=None, by_length: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.  ``sets`` replaces the word shingles by other sets."""
    return labelled(docs, width, percent, sets, by_length).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without the near duplicates: of each group the row of the smallest id stays (rows without an id come last, and equal
    ids are told apart by their texts).  Rows equal in id and text are one document and stay or go together; rows
    without words are no duplicates of anything and stay."""
    rows = labelled(docs.select("doc_id", "text"), width, percent)
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    gone = rows.filter(here != F.col("first")).select(F.col("doc_id").alias("__gi"), F.col("th").alias("__gt")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gi")) & (text_hash() == F.col("__gt"))
    return docs.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
