import zlib
from math import comb

import numpy as np
import pytest

from tallystone.llm import sharding
from tests.llm.fixtures import ROWS, awkward, empty


def test_report(spark):
    rows = sharding.report(awkward(spark, 20)).collect()
    assert len(rows) == 20 * len(ROWS)
    sizes = np.bincount([r.shard for r in rows], minlength=24)
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    texts = {i: t or "" for i, t, *_ in ROWS}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_matrix_keeps_both_margins():
    m = sharding.matrix([100, 0, 7, 1, 250], 24)
    assert m.sum(1).tolist() == [100, 0, 7, 1, 250] and m.sum(0).max() - m.sum(0).min() <= 1 and m.min() >= 0


def test_shuffle_is_uniform(spark):
    rows = sharding.shard(spark.range(0, 6000, numPartitions=6), shards=6).toPandas()
    table = np.zeros((6, 6))
    for a, s in zip(rows["id"] // 1000, rows["shard"], strict=True):
        table[a, s] += 1
    # Chi-square of origin against shard: 25 degrees of freedom.
    assert ((table - 1000 / 6) ** 2 / (1000 / 6)).sum() < 60
    # Exactly the drawn matrix: partitions keep their rows, and each deals out its line.
    assert table.tolist() == sharding.matrix([1000] * 6, 6).tolist()
    first = rows.sort_values(["shard", "slot"])["id"].to_numpy()
    assert abs(np.corrcoef(first, np.arange(6000))[0, 1]) < 0.06


def test_blocks_of_a_large_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    rows = sharding.shard(spark.range(0, 3000, numPartitions=4), shards=2).toPandas()
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(1500))


def test_empty_and_clashing(spark):
    assert sharding.report(empty(spark)).count() == 0
    out = sharding.shard(awkward(spark))
    assert [c.lower() for c in out.columns].count("shard") == 1


def test_internal_names_may_clash(spark):
    names = ["part", "at", "key", "block", "row", "n", "rank", "before", "__part", "Slot"]
    df = spark.createDataFrame([tuple(range(10)), tuple(range(10, 20))], names)
    out = sharding.shard(df, shards=2)
    assert out.columns == [*names[:-1], "shard", "slot"]
    assert sorted(tuple(r)[:9] for r in out.collect()) == [tuple(range(9)), tuple(range(10, 19))]


def test_equal_rows_are_dealt_apart(spark):
    rows = sharding.shard(spark.createDataFrame([("same",)] * 2400, "text string").repartition(2), shards=4).toPandas()
    assert rows.groupby("shard").size().tolist() == [600] * 4


def test_binomial_path_draws_the_hypergeometric_law(monkeypatch):
    monkeypatch.setattr(sharding, "GENERATOR_RANGE", 0)
    monkeypatch.setattr(sharding, "SINGLE", 1)
    rng, good, bad, n = np.random.default_rng(2), 7, 9, 6
    got = np.bincount([sharding._draw(rng, good, bad, n) for _ in range(6000)], minlength=n + 1)
    want = 6000 * np.array([comb(good, k) * comb(bad, n - k) for k in range(n + 1)]) / comb(good + bad, n)
    assert ((got - want) ** 2 / want).sum() < 22  # six degrees of freedom


def test_large_draws_have_the_right_spread():
    rng, good, bad, n = np.random.default_rng(6), 3 * 10**10, 7 * 10**10, 10**9
    got = np.array([sharding._draw(rng, good, bad, n) for _ in range(400)])
    sd = (n * 0.3 * 0.7 * (1 - n / 10**11)) ** 0.5
    assert abs(got.mean() - 0.3 * n) < 4 * sd / 20 and 0.8 < got.std() / sd < 1.2


@pytest.mark.parametrize("case", [(10, 0, 4), (0, 10, 4), (2_000_000_000, 2_000_000_000, 10), (2_000_000_000, 2_000_000_000, 1_000_000)])
def test_draws_stay_in_range(case):
    good, bad, n = case
    assert max(0, n - bad) <= sharding._draw(np.random.default_rng(1), good, bad, n) <= min(n, good)
