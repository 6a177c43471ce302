"""Exact selection against numpy, DBSCAN over cells and ring search against all pairs."""

import math
import random

import numpy as np
import pytest

from roadlens.operators import cluster, news, selection


@pytest.mark.parametrize("few", [1, 50])
def test_percentiles_match_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", 64)
    rng = random.Random(few)
    make = {
        "ties": lambda: float(rng.randint(0, 3)), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300), "plain": lambda: rng.gauss(0, 1),
        "close": lambda: np.nextafter(1.0, 2) if rng.random() < 0.5 else 1.0, "one": lambda: 7.0, None: lambda: rng.random(),
    }
    rows = [(g, float(f())) for g, f in make.items() for _ in range(300 if g != "one" else 1)]
    rows += [("nulls", None)] * 3 + [("plain", None)]
    probabilities = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r[1:] for r in selection.exact_percentiles(df, "v", probabilities, ["g"]).collect()}
    assert set(got) == set(make) | {"nulls"} and got["nulls"] == (None,) * 6
    for g in make:
        values = sorted(v for h, v in rows if h == g and v is not None)
        for p, v in zip(probabilities, got[g]):
            at = (len(values) - 1) * p
            a, b = values[math.floor(at)], values[math.ceil(at)]
            assert v == pytest.approx(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b, rel=1e-12)
    one = selection.exact_percentiles(df.filter("g = 'plain'"), "v", (0.5,)).collect()
    assert [r.p0 for r in one] == [got["plain"][2]]
    assert selection.exact_percentiles(df.limit(0), "v", (0.5,)).collect()[0].p0 is None
    assert selection.exact_percentiles(df.limit(0), "v", (0.5,), ["g"]).collect() == []


def test_no_group_is_gathered(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "CAST(id AS double) AS v", "CAST(id % 5 AS string) AS t")
    for out in (selection.exact_percentiles(df, "v", (0.5,), ["g"]), selection.exact_modes(df, ["t"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "mode(" not in plan and "collect_" not in plan
    assert selection.exact_modes(df, ["t"]).first().value == "0"  # the least on ties


def all_pairs_dbscan(points, eps, least):
    near = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= eps
    around = {p[0]: [q[0] for q in points if near(p, q)] for p in points}
    core = {i for i, q in around.items() if len(q) >= least}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            least_label = min(label[j] for j in around[i] if j in core)
            if least_label < label[i]:
                label[i], changed = least_label, True
    out = {}
    for i, q in around.items():
        reached = [label[j] for j in q if j in core]
        out[i] = ("core", label[i]) if i in core else ("border", min(reached)) if reached else ("noise", None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dbscan_matches_all_pairs(spark, seed):
    rng = random.Random(seed)
    points = []
    for _ in range(25):
        y, x, spread = rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05), rng.choice([0.0005, 0.003, 0.01])
        points += [(y + rng.gauss(0, spread), x + rng.gauss(0, spread)) for _ in range(rng.randint(1, 14))]
    points += [(0.01 * k, 0.2) for k in range(8)] + [(0.0, 0.3)] * 9  # at the very distance; all in one place
    points = [(i, y, x) for i, (y, x) in enumerate(points)]
    df = spark.createDataFrame([(i, "hanoi", y, x) for i, y, x in points] + [(9999, "hanoi", None, 1.0)], "segment_id int, city string, lat double, lon double")
    got = {r.segment_id: (r.point_type, r.cluster_id) for r in cluster.dbscan_labels(df, params={"hanoi": (0.01, 4)}).collect()}
    assert got.pop(9999) == ("noise", None)
    assert got == all_pairs_dbscan(points, 0.01, 4)


def test_dbscan_dense_cells_make_no_pairs(spark):
    dense = spark.range(100_000).selectExpr("CAST(id AS string) AS segment_id", "'hanoi' AS city", "21 + (id % 317) * 1e-5 AS lat", "105.8 + (id div 317) * 2e-5 AS lon")
    got = cluster.dbscan_labels(dense).groupBy("point_type", "cluster_id").count().collect()
    assert [(r.point_type, r.cluster_id, r["count"]) for r in got] == [("core", "0", 100_000)]


def distance(a, b):
    (y, x), (v, u) = (map(math.radians, p) for p in (a, b))
    return 2 * 6371000 * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))


def test_ring_search_matches_all_pairs(spark):
    rng = random.Random(4)
    spot = lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180)) if rng.random() < 0.3 else (21 + rng.gauss(0, 0.03), 105.8 + rng.gauss(0, 0.03))
    edge = [(0.0, 179.999), (0.0, -179.999), (89.999, 10.0), (89.99, -170.0), (-90.0, 0.0), (10.0, 180.0), (45.0, -180.0)]
    segments = [(f"s{i}", *p) for i, p in enumerate([spot() for _ in range(120)] + edge)]
    events = [(i, *p) for i, p in enumerate([spot() for _ in range(150)] + edge + [(1.0, 179.9995), (-89.0, 77.0)])] + [(900, None, 1.0), (900, None, 1.0), (0, 21.0, 105.8), (0, 21.0, 105.8)]
    e = spark.createDataFrame(events, "name int, lat double, lon double")
    s = spark.createDataFrame(segments + [("s3", None, None)], "segment_id string, lat double, lon double")
    got = news.snap_to_segment(e, s, 0.01).collect()
    assert len(got) == len(events)
    for r in got:
        if r.lat is None:
            assert r.snapped_segment_id is None and r.snap_distance_m is None
        else:
            assert r.snap_distance_m == pytest.approx(min(distance((r.lat, r.lon), p[1:]) for p in segments), abs=1e-3)
            assert r.snapped_segment_id is not None
    assert [r.snapped_segment_id for r in news.snap_to_segment(e, s.limit(0)).collect()] == [None] * len(events)
    near = news.snap_to_segment(e, s, max_km=1.0)
    assert near.filter("snap_distance_m > 1000 AND snapped_segment_id IS NOT NULL").isEmpty()
