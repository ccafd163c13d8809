"""Centroid clustering next to plain Python."""

import hashlib
import math
import random

import numpy as np

from meshloom.llm import bitplanes


def plain(rows, k, rounds):
    """rows: (vec_id, whole numbers)."""
    text = lambda i: "" if i is None else str(i)
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{text(r[0])}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for c in range(len(centroids)):
            mine = [v for (_, v), n in zip(rows, own) if n == c]
            if mine:
                centroids[c] = [math.floor(sum(x) / 1) // len(mine) for x in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in rows), key=repr), centroids


def run(spark, rows, width, k=4, rounds=5):
    table = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    placed, centroids = bitplanes.cluster(table, k, rounds, width)
    return sorted((tuple(r) for r in placed.collect()), key=repr), centroids


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for width, most in ((64, 1024), (64, 2**26), (5, 3), (130, 700)):
        values = rng.integers(-most, most, (40, width))
        values[0], values[1] = -most, most
        planes = bitplanes.to_planes(values, most.bit_length() + 1)
        assert (bitplanes.products(planes, planes[3]) == values @ values[3]).all()
        assert (bitplanes.norms(planes) == (values * values).sum(axis=1)).all()
        assert (bitplanes.component_sums(planes, width) == values.sum(axis=0)).all()


def test_against_plain(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-30, 30) + 40 * (i % 3) for _ in range(6)]) for i in range(150)]
    rows += [(3, rows[3][1]), (3, [1] * 6), (None, [0] * 6)] + [(500 + i, [7] * 6) for i in range(60)]
    assert run(spark, rows, 6) == plain(rows, 4, 5)
    ties = [(i, [0, i % 2]) for i in range(20)]
    assert run(spark, ties, 2) == plain(ties, 4, 5)


def test_few_none_and_refused(spark):
    rows = [(1, [5] * 64), (2, [-5] * 64)]
    placed, centroids = run(spark, rows, 64, k=8)
    assert len(centroids) == 2 and [r[2] for r in placed] == [0, 0]
    schema = "vec_id long, embedding array<double>, cluster int, distance string"
    bad = [(1, None), (2, [1.0] * 63), (3, [None] + [0.0] * 63), (4, [float("nan")] * 64), (5, [float("-inf")] + [0.0] * 63), (6, [1e30] * 64), (7, [0.5] * 64), (None, [-0.0001] * 64)]
    whole = bitplanes.whole_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in bad], schema))
    assert {r["vec_id"]: set(r["v"]) for r in whole.collect()} == {7: {512}, None: {-1}}
    empty, none = bitplanes.cluster(whole.filter("false"))
    assert none == [] and bitplanes.with_inertia(empty, none).isEmpty()


def test_sums_over_clusters(spark):
    rows = [(i, [i * i % 50, -i]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = bitplanes.with_inertia(*bitplanes.cluster(table, 3, 2, 2)).collect()
    want, centroids = plain(rows, 3, 2)
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
