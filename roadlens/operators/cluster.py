"""Density clustering of segment positions (DBSCAN over a graph of cells) and cluster statistics.

Points are dealt into cells whose diagonal is a little below eps, so points of one cell are neighbours.  A
cell of ``min_samples`` points or more is all core, without looking at any pair; only points of other cells (fewer
than ``min_samples`` each) count their neighbours in the cells around.  Core cells within reach of each other are
linked if their closest core points are within eps: decided by the bounding boxes of their points, of halves where
boxes leave it open, and at last by the points of the few boxes still open.  Clusters are connected components of cells.
No table of neighbour pairs is made; a cell of any number of points costs its points.

Labels: a cluster is named by its smallest core id; a border point takes the smallest label among its core
neighbours.  Points without a position are noise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, materialize

# Per-city eps (degrees) and min_samples.
DBSCAN_PARAMS = {"hanoi": (0.01, 5), "hcmc": (0.015, 4)}
DEFAULT_PARAMS = (0.01, 5)
#: Halvings of a cell before the points of open boxes are compared.
LEVELS = 4
#: A cell's diagonal against eps: below 1 by more than rounding can add.
SHRINK = 1 - 1e-9


def _params_col(city: str, params: dict, which: int):
    expr = None
    for c, p in params.items():
        expr = F.when(F.col(city) == c, F.lit(p[which])) if expr is None else expr.when(F.col(city) == c, F.lit(p[which]))
    return F.lit(DEFAULT_PARAMS[which]) if expr is None else expr.otherwise(F.lit(DEFAULT_PARAMS[which]))


def _distance(dy: Column, dx: Column) -> Column:
    return F.sqrt(F.pow(dy, 2) + F.pow(dx, 2))


def _around(df: DataFrame, half: bool) -> DataFrame:
    """df once for every cell that can hold points within eps of its own cell (or for half of them, each pair once)."""
    offsets = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if ((a, b) > (0, 0) if half else (a, b) != (0, 0))]
    cells = F.array(*[F.struct((F.col("cy") + a).alias("ny"), (F.col("cx") + b).alias("nx")) for a, b in offsets])
    return df.withColumn("_n", F.explode(cells)).withColumn("cy", F.col("_n.ny")).withColumn("cx", F.col("_n.nx")).drop("_n")


def _near(points: DataFrame, others: DataFrame) -> DataFrame:
    """(id, nid): others (nid) within eps of points, in the cells around theirs."""
    probe = _around(points.select("id", "city", "y", "x", "eps", "cy", "cx"), half=False)
    other = others.select(F.col("id").alias("nid"), "city", F.col("y").alias("ny"), F.col("x").alias("nx"), "cy", "cx")
    met = probe.join(other, ["city", "cy", "cx"])
    return met.filter(_distance(F.col("y") - F.col("ny"), F.col("x") - F.col("nx")) <= F.col("eps")).select("id", "nid")


def _boxes(core: DataFrame, level: int, side: str) -> DataFrame:
    by, bx = (F.shiftright(c, LEVELS - level) for c in ("by", "bx"))
    box = core.groupBy("rep", by.alias("by"), bx.alias("bx")).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return box.select(*[F.col(c).alias(side + c) for c in box.columns])


def _cell_links(core: DataFrame) -> DataFrame:
    """(a, b) of cells (rep) that hold core points within eps of each other."""
    cells = core.groupBy("city", "cy", "cx", "eps", "rep").agg(F.count(F.lit(1)).alias("n"))
    here = _around(cells.select(F.col("rep").alias("a_rep"), "eps", "city", "cy", "cx"), half=True)
    open_ = here.join(cells.select(F.col("rep").alias("b_rep"), "city", "cy", "cx"), ["city", "cy", "cx"]).select("a_rep", "b_rep", "eps")
    gap = lambda c: F.greatest(F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.lit(0.0))
    reach = lambda c: F.greatest(F.col(f"a_{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"a_{c}0"))
    linked = None
    for level in range(LEVELS + 1):
        a, b = _boxes(core, level, "a_"), _boxes(core, level, "b_")
        if level:  # boxes of the boxes that are still open
            up = lambda s: [F.shiftright(s + "by", 1).alias(s + "py"), F.shiftright(s + "bx", 1).alias(s + "px")]
            a, b = a.select("*", *up("a_")), b.select("*", *up("b_"))
            parent = {s: ["a_rep", "a_py", "a_px"] if s == "a_" else ["b_rep", "b_py", "b_px"] for s in ("a_", "b_")}
            open_ = open_.join(a, parent["a_"]).join(b, parent["b_"])
        else:
            open_ = open_.join(a, "a_rep").join(b, "b_rep")
        open_ = open_.filter(_distance(gap("y"), gap("x")) <= F.col("eps"))
        sure = _distance(reach("y"), reach("x")) <= F.col("eps")
        open_ = materialize(open_.select("a_rep", "b_rep", "eps", "a_by", "a_bx", "b_by", "b_bx", sure.alias("sure")))
        found = materialize(open_.filter("sure").select("a_rep", "b_rep").distinct())
        linked = found if linked is None else linked.unionByName(found)
        open_ = open_.join(found, ["a_rep", "b_rep"], "left_anti").drop("sure")
        if open_.isEmpty():
            return linked
        py = lambda s: [F.col(s + "by").alias(s + "py"), F.col(s + "bx").alias(s + "px")]
        last = open_
        open_ = open_.select("a_rep", "b_rep", "eps", *py("a_"), *py("b_"))
    points = lambda s: core.select(*[F.col(c).alias(s + c) for c in ("rep", "by", "bx", "y", "x")])
    met = last.join(points("a_"), ["a_rep", "a_by", "a_bx"]).join(points("b_"), ["b_rep", "b_by", "b_bx"])
    met = met.filter(_distance(F.col("a_y") - F.col("b_y"), F.col("a_x") - F.col("b_x")) <= F.col("eps"))
    return linked.unionByName(met.select("a_rep", "b_rep").distinct())


def dbscan_labels(points: DataFrame, id_col: str = "segment_id", lat: str = "lat", lon: str = "lon", city: str = "city",
                  params: dict | None = None) -> DataFrame:
    """(id, city, point_type core/border/noise, cluster_id or null for noise).  Ids are unique; a null city is one of its own."""
    params = DBSCAN_PARAMS if params is None else params
    p = points.select(F.col(id_col).alias("id"), F.col(city).alias("own"), F.coalesce(F.col(city), F.lit("")).alias("city"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    p = p.withColumn("eps", _params_col("own", params, 0).cast("double")).withColumn("minpts", _params_col("own", params, 1))
    p = p.withColumn("city", F.concat(F.col("own").isNull().cast("string"), F.lit(":"), "city"))  # a null city is no empty name
    # boxes at the finest level; a cell is 2**LEVELS boxes wide
    side = F.col("eps") * (SHRINK / math.sqrt(2) / 2**LEVELS)
    p = p.withColumn("by", F.floor(F.col("y") / side)).withColumn("bx", F.floor(F.col("x") / side))
    p = materialize(p.withColumn("cy", F.shiftright("by", LEVELS)).withColumn("cx", F.shiftright("bx", LEVELS)))
    at = p.filter("y IS NOT NULL AND x IS NOT NULL")
    per_cell = at.groupBy("city", "cy", "cx").agg(F.count(F.lit(1)).alias("n"))
    at = at.join(per_cell, ["city", "cy", "cx"])
    sparse = materialize(at.filter(F.col("n") < F.col("minpts")))
    around = _near(sparse, p).groupBy("id").agg(F.count(F.lit(1)).alias("m"))
    sparse_core = sparse.join(around, "id", "left").filter(F.col("n") + F.coalesce("m", F.lit(0)) >= F.col("minpts")).drop("m")
    core = at.filter(F.col("n") >= F.col("minpts")).unionByName(sparse_core.select(*at.columns))
    core = core.select("id", "city", "y", "x", "eps", "cy", "cx", "by", "bx")
    reps = core.groupBy("city", "cy", "cx").agg(F.min("id").alias("rep"))
    core = materialize(core.join(reps, ["city", "cy", "cx"]))
    cells = core.select("city", "cy", "cx", "rep").distinct()
    comp = connected_components(cells, materialize(_cell_links(core)), "rep", "a_rep", "b_rep")
    core = materialize(core.join(comp, "rep"))
    # a border point: its own cell's core points are within eps, those of the cells around are measured
    rest = sparse.join(core.select("id"), "id", "left_anti")
    label = core.select("id", "component")
    beside = _near(rest, core).join(label.withColumnRenamed("id", "nid"), "nid").select("id", "component")
    inside = rest.select("id", "city", "cy", "cx").join(core.select("city", "cy", "cx", "component").distinct(), ["city", "cy", "cx"]).select("id", "component")
    border = beside.unionByName(inside).groupBy("id").agg(F.min("component").alias("bcomp"))
    out = p.select("id", "own").join(label, "id", "left").join(border, "id", "left")
    kind = F.when(F.col("component").isNotNull(), "core").when(F.col("bcomp").isNotNull(), "border").otherwise("noise")
    return out.select(F.col("id").alias(id_col), F.col("own").alias("city"), kind.alias("point_type"), F.coalesce("component", "bcomp").alias("cluster_id"))


def cluster_stats(points: DataFrame, labels: DataFrame, id_col: str = "segment_id") -> DataFrame:
    """Per cluster: centre, members, speed avg/min/max, mean congestion and jam, severity bin
    (0-.3 low, .3-.6 medium, .6-1 high), radius km = max distance to centre * 111."""
    j = points.join(labels.filter(F.col("cluster_id").isNotNull()).select(id_col, "cluster_id"), id_col)
    g = j.groupBy("cluster_id").agg(
        F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), F.count(F.lit(1)).alias("num_segments"),
        F.avg("currentSpeed").alias("avg_speed"), F.min("currentSpeed").alias("min_speed"), F.max("currentSpeed").alias("max_speed"),
        F.avg("congestion_ratio").alias("avg_congestion"), F.avg("jamFactor").alias("avg_jam_factor"))
    c = F.col("avg_congestion")
    g = g.withColumn("severity", F.when((c >= 0) & (c <= 0.3), "low").when((c > 0.3) & (c <= 0.6), "medium").when((c > 0.6) & (c <= 1.0), "high"))
    r = j.join(g.select("cluster_id", "center_lat", "center_lon"), "cluster_id").groupBy("cluster_id").agg(
        (F.max(F.sqrt(F.pow(F.col("lat") - F.col("center_lat"), 2) + F.pow(F.col("lon") - F.col("center_lon"), 2))) * F.lit(111.0)).alias("radius_km"))
    return g.join(r, "cluster_id")
