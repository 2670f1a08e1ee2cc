import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import centroids
from tests.oracle import differences


def brute(rows, k=16, rounds=3):
    """Every vector against every centroid, in Python's own integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(max(-(1 << 27), min(1 << 27, np.floor(64.0 * x)))) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centres[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, near(v)) for i, v in kept]
    inertia = sum(d for _, (d, _) in found)
    by = {}
    for _, (d, j) in found:
        by[j] = by.get(j, 0) + d
    sha = {j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest() for j in by}
    return sorted((str(i), j, d, by[j], inertia, sha[j]) for i, (d, j) in found)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in centroids.report(df).collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_sql_on_a_whole_table(spark):
    assert differences(centroids.report(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")), centroids.oracle(), "/root/testdata/sf0.001") == []


@pytest.mark.parametrize("scale", [0.02, 0.5, 40.0])
def test_brute_force_with_ties(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(int(i), np.round(rng.normal(0, scale, 64), 2 if scale < 1 else 0).astype(np.float32).tolist()) for i in range(120)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(60)]  # copies of a few vectors, a third of all
    assert got(table(spark, rows)) == brute(rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    one = rng.normal(0, 1, 64).astype(np.float32).tolist()
    rows = [(1, one), (1, one), (None, one[::-1]), (2, None), (3, []), (4, one[:63]), (5, one + [0.0]), (6, [None] + one[1:]), (7, [float("nan")] + one[1:]), (8, [float("inf")] + one[1:]), (9, [3e38] + one[1:]), (10, [-3e38] + one[1:])]
    assert got(table(spark, rows)) == brute(rows)
    assert len(got(table(spark, rows))) == 5


def test_empty_tables_and_clashing_columns(spark):
    assert got(table(spark, [])) == [] and got(table(spark, [(1, None)])) == []
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 40")
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("cluster", "distance", "v", "n", "total", "part", "inertia")])
    assert got(clashing) == got(df)


def test_the_scan_skips_and_is_still_exact():
    rng = np.random.default_rng(4)
    centres = rng.integers(-100, 100, (16, 64))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-3, 4, (4000, 64))
    full = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    number, distance, computed = centroids.sort_means(points, centres, full.argmin(1).astype(np.int32))
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert computed == 4000  # the previous centroid is so near that no other is looked at
    number, distance, computed = centroids.sort_means(points, centres, np.zeros(4000, np.int32))
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_equality_does_not_stop_the_scan():
    # The middle between two centroids: the gap is exactly twice the distance, and the smaller number wins.
    centres = np.zeros((2, 64), np.int64)
    centres[0, 0] = 2
    point = np.zeros((1, 64), np.int64)
    point[0, 0] = 1
    assert centroids.sort_means(point, centres, np.array([1], np.int32))[0].tolist() == [0]


def test_large_components_are_exact(spark):
    big = [[float(x)] + [0.0] * 63 for x in (1 << 20, -(1 << 20), (1 << 20) + 2, 1 << 10)]
    rows = [(i, v) for i, v in enumerate(big)]
    assert got(table(spark, rows)) == brute(rows)
