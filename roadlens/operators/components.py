"""Connected components by hooking and contraction.

Each round every node that has a smaller neighbour hooks to the smallest one; the hooks form
trees, whose paths are halved until every node points at its root; the edges are then renamed to
roots and those inside one tree vanish.  At least half of the nodes that still have edges vanish per round, so a
chain of any length takes a logarithmic number of rounds; there is no round limit.
Where the caller allows it, edges that are few (from the start or after some rounds) are joined up in one task instead of further rounds.
Every round's tables are written to the shared folder of the session (``materialize``), so the
lineage stays short and a lost executor rereads files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several later steps read (signatures, labels) as Parquet into the shared
    checkpoint folder and read it back: the expensive expressions run once, later steps prune its
    columns, and a lost executor does not recompute the whole chain."""
    return _stored(df, {})


def materialize_packed(df: DataFrame) -> DataFrame:
    """``materialize`` for long texts: packed more tightly, for some more CPU time."""
    return _stored(df, {"compression": "zstd"})


def _stored(df: DataFrame, options: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def many_tasks(spark: SparkSession) -> int:
    """Tasks for work that is much for its bytes: a few per core, or as many as a shuffle has."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _at_roots(hooks: DataFrame) -> DataFrame:
    """(node, parent) trees -> (node, parent) with every parent a root, by pointer doubling."""
    while True:
        up = hooks.select(F.col("node").alias("p"), F.col("parent").alias("grand"))
        step = hooks.join(up, hooks["parent"] == up["p"], "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
        step = materialize(step)
        hooks = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return hooks


# Edges that one task may join up (some 20 MB of memory); a single round of jobs takes longer than that.
FEW_EDGES = 50_000


def _small_trees(edges: DataFrame) -> DataFrame:
    """(node, parent) for every end of the edges (lo < hi) that is not the least of its component; parent is the least one."""
    schema = StructType([StructField("node", edges.schema["hi"].dataType), StructField("parent", edges.schema["lo"].dataType)])
    return edges.select(F.lit(0).alias("_all"), "lo", "hi").groupBy("_all").applyInArrow(_joiner(), schema)


def _joiner():
    def join_up(table):
        import pyarrow as pa

        up: dict = {}

        def root(x):
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for a, b in zip(table.column("lo").to_pylist(), table.column("hi").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in list(up)]
        found = [(x, r) for x, r in found if x != r]
        kind = table.schema.field("lo").type
        return pa.table([pa.array([x for x, _ in found], kind), pa.array([r for _, r in found], kind)], names=["node", "parent"])

    return join_up  # a function of a function: workers need not have this module


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id", src: str = "src", dst: str = "dst", few: int = 0) -> DataFrame:
    """(id) + undirected edges (src, dst) -> (id, component) with component = min id reachable.  Once there are no more than ``few`` edges, one
    task joins them up."""
    a, b = F.col(src), F.col(dst)
    left = edges.filter(a != b).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    left = materialize(left)
    roots = None
    if not isinstance(left.schema["lo"].dataType, (IntegralType, StringType)):
        few = 0  # Python orders only those as Spark does
    while not left.isEmpty():
        last = few > 0 and left.count() <= few
        hooks = materialize(_small_trees(left)) if last else _at_roots(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        name = hooks.select(F.col("node").alias("n"), F.col("parent").alias("r"))
        if roots is None:
            roots = hooks
        else:
            moved = roots.join(name, roots["parent"] == name["n"], "left").select("node", F.coalesce("r", "parent").alias("parent"))
            known = roots.select(F.col("node").alias("k"))
            roots = materialize(moved.unionByName(hooks.join(known, hooks["node"] == known["k"], "left_anti")))
        if last:
            break
        lo = left.join(name, left["lo"] == name["n"], "left").select(F.coalesce("r", "lo").alias("lo"), "hi")
        both = lo.join(name, lo["hi"] == name["n"], "left").select("lo", F.coalesce("r", "hi").alias("hi"))
        left = materialize(both.filter("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())
    ids = vertices.select(F.col(id_col)).distinct()
    if roots is None:
        return ids.withColumn("component", F.col(id_col))
    return ids.join(roots, ids[id_col] == roots["node"], "left").select(F.col(id_col), F.coalesce("parent", id_col).alias("component"))
