"""Elkan clustering against plain assignment with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from rasterlane.llm import elkan

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string, v int"


def plain(rows, k=16, rounds=3, dim=64):
    kept = [(i, [max(-elkan.MOST, min(elkan.MOST, math.floor(64 * x))) if abs(x) < 1e300 else int(math.copysign(elkan.MOST, x)) for x in v])
            for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=repr), centroids


def sample():
    rnd = random.Random(4)
    centres = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rnd.gauss(0, 0.15) for x in centres[i % 9]]) for i in range(240)]
    rows += [(1000 + i, [float(i % 3)] * 64) for i in range(60)]  # many ties
    rows += [(i, rows[i][1]) for i in range(30)]  # repeated rows
    rows += [(5, [0.5] * 64), (None, [0.25] * 64), (None, None), (2000, []), (2001, [0.1] * 63), (2002, [0.1] * 65), (2003, [None] + [0.1] * 63), (2004, [math.nan] + [0.1] * 63), (2005, [math.inf] + [0.1] * 63), (2006, [1e308] * 64), (2007, [-0.0] * 64)]
    return rows


def test_clusters_equal_brute_force(spark):
    rows = sample()
    got, centroids = elkan.cluster(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(5))
    want, at = plain(rows)
    assert sorted(((r.id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert centroids.tolist() == at


def test_few_and_no_vectors(spark):
    few = [(i, [i / 7] * 64) for i in (3, 1, 2)]
    got, centroids = elkan.cluster(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in few], SCHEMA))
    assert len(centroids) == 3 and sorted((r.id, r.distance) for r in got.collect()) == [(1, 0), (2, 0), (3, 0)]
    got, centroids = elkan.cluster(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and not len(centroids) and [c[0] for c in got.dtypes] == ["id", "cluster", "distance"]


def test_bounds_skip_and_never_lie():
    """Pruned passes agree with full ones after every move of the centroids, and compute far fewer distances."""
    rnd = np.random.default_rng(3)
    v = (rnd.integers(-50, 50, (8, 64))[rnd.integers(0, 8, 2000)] + rnd.integers(-4, 5, (2000, 64))).astype(np.int64)
    now = v[:16].copy()
    now[5] = now[2]  # two equal centroids
    own, upper, lower, before, counts = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros((len(v), 16)), None, []
    for _ in range(4):
        own, squared, upper, lower, n = elkan.Step(now, before).assign(v, own, upper, lower)
        every = np.stack([elkan.squares(v, c) for c in now], 1)
        assert (own == every.argmin(1)).all()
        upper, lower = elkan.single_above(upper), elkan.single_below(lower)
        assert (upper.astype(np.float64) ** 2 >= every.min(1)).all() and (lower.astype(np.float64) ** 2 <= every).all()
        counts.append(n)
        before, now = now, np.stack([v[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else now[j] for j in range(16)])
    assert sum(counts) < 0.6 * 4 * v.shape[0] * 16


@pytest.mark.parametrize("x", [0, 1, 2, 2**31 - 1, 2**53 + 1, 2**62 - 1])
def test_rounding_is_outwards(x):
    a = np.array([x], np.int64)
    assert int(elkan.above(a)[0].as_integer_ratio()[0]) ** 2 >= x * int(elkan.above(a)[0].as_integer_ratio()[1]) ** 2
    p, q = float(elkan.single_below(elkan.below(a))[0]).as_integer_ratio()
    assert p * p <= x * q * q


def test_query_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    df = elkan.op11_elkan_clusters(spark, "/root/testdata/sf0.001")
    cur = c.execute(elkan.ORACLE)
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
