import hashlib
import math
import random

import numpy as np
import pytest

from quarrymill.llm import centroids


def plain(rows, k=8, rounds=10, dim=64, scale=1024, seed=3):
    """Lloyd's rounds by plain loops: {row: (cluster, distance)}, centroids."""
    kept = [(key, [math.floor(scale * float(np.float64(x))) for x in v]) for key, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), np.array(v, np.int64).tobytes(), v) for key, v in kept if key is not None)[:k]
    cs = [v for *_, v in start]
    sq = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda: [min((sq(v, c), j) for j, c in enumerate(cs)) for _, v in kept]
    for _ in range(rounds):
        at = [j for _, j in place()]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(key, j, d) for (key, _), (d, j) in zip(kept, place(), strict=True)], cs


SCHEMA = "vec_id long, embedding array<float>, label int, block int, near int, KEY int, cluster int, starts int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2, 3, 4, 5, 6) for k, v in rows], SCHEMA).repartition(3)


def check(spark, rows, **how):
    got = centroids.cluster(table(spark, rows), **how).collect()
    want, cs = plain(rows, **how)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == sorted((str(k), j, d) for k, j, d in want)
    total = {}
    for _, j, d in want:
        total[j] = total.get(j, 0) + d
    for r in got:
        text = ",".join(map(str, cs[r["cluster"]]))
        assert (r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (total[r["cluster"]], sum(total.values()), hashlib.sha256(text.encode()).hexdigest())
    return got


def test_op11(spark):
    rng = random.Random(2)
    hubs = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(5)]
    f = lambda xs: [float(np.float32(x)) for x in xs]
    rows = [(i, f(x + rng.gauss(0, 0.1) for x in hubs[i % 5])) for i in range(400)]
    rows += [(500, None), (501, []), (502, [0.5] * 63), (503, [None] * 64), (504, [0.1] * 63 + [math.nan]), (505, [math.inf] + [0.1] * 63), (506, [0.0] * 64), (None, rows[0][1]), (None, rows[0][1]), (3, rows[9][1]), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(600 + i, [0.25] * 64) for i in range(200)]
    check(spark, rows)


def test_op11_ties_and_empty_centroids(spark):
    """Few distinct points on a grid: equal distances, starts that coincide, centroids without vectors."""
    rng = random.Random(3)
    points = [[rng.choice((-1.0, 0.0, 1.0)) for _ in range(3)] for _ in range(12)]
    rows = [(i, rng.choice(points)) for i in range(300)]
    got = check(spark, rows, k=9, rounds=4, dim=3, scale=2)
    assert len({r["cluster"] for r in got}) < 9
    check(spark, rows[:5], k=9, rounds=2, dim=3, scale=2)
    check(spark, rows, k=1, rounds=2, dim=3, scale=2)
    check(spark, rows, k=4, rounds=0, dim=3, scale=2)


def test_op11_of_nothing_and_of_wide_vectors(spark):
    assert centroids.cluster(table(spark, [(1, None), (2, [1.0])])).collect() == []
    got = {r["vec_id"]: r for r in centroids.cluster(table(spark, [(1, [1.0, 2.0]), (2, [3e38, 0.0]), (3, [1.0, 2.0])]), dim=2, k=2, rounds=2).collect()}
    assert got[1]["cluster"] == got[3]["cluster"] == 0 and got[2]["cluster"] is None and got[2]["inertia"] == 0
    assert [r["cluster"] for r in centroids.cluster(table(spark, [(None, [1.0, 2.0])]), dim=2).collect()] == [None]
    with pytest.raises(ValueError):
        centroids.cluster(table(spark, []), dim=500)


def test_search_measures_few_distances_and_finds_the_nearest():
    """Rounds of moving centroids: every search equals a scan of all, and bounds save most distances once clusters settle."""
    rng = np.random.default_rng(4)
    hubs = rng.integers(-3000, 3000, (40, 8))
    x = (hubs[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 8))).astype(np.int64)
    values = x[rng.choice(5000, 40, replace=False)]
    near, upper, lower = np.zeros(5000, np.int64), np.full(5000, np.inf), np.zeros(5000)
    counts = []
    for _ in range(8):
        near, upper, lower, n = centroids.search(x, centroids.Centroids(values), near, upper, lower)
        far = ((x[:, None] - values) ** 2).sum(axis=2)
        assert (near == far.argmin(axis=1)).all()
        assert (upper * (1 + 1e-6) >= np.sqrt(far.min(axis=1))).all() and (lower <= np.sqrt(np.partition(far, 1, axis=1)[:, 1]) * (1 + 1e-6)).all()
        counts.append(n)
        new = np.array([x[near == j].sum(axis=0) // max(1, (near == j).sum()) if (near == j).any() else values[j] for j in range(40)])
        upper, lower = centroids.loosened(near, upper, lower, np.sqrt(centroids.squares(new, values)))
        values = new
    assert counts[-1] < 5000 * 40 / 20


def test_rounds_read_buckets_without_a_shuffle(spark):
    from quarrymill.llm import scratch

    a = scratch.save_buckets(spark.range(100).selectExpr("id AS block", "id AS x"), "a", "block", 4)
    b = scratch.save_buckets(spark.range(100).selectExpr("id AS block", "id AS y"), "b", "block", 4)
    met = a.hint("merge").join(b, "block")
    assert met.count() == 100 and "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    scratch.drop(a, b)
