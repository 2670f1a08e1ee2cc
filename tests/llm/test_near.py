import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallystone.llm import common, near
from tallystone.llm.components import roots
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.01"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def groups(rows):
    """Every pair is compared by its sets of shingles."""
    made = [(i, sets(t)) for i, t in rows]
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(made):
        for b, (_, y) in enumerate(made[:a]):
            small, large = sorted((len(x), len(y)))
            if small >= 0.8 * large and alike(x, y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    out = {}
    for k, (i, _) in enumerate(made):
        out.setdefault(find(k), []).append(i)
    return list(out.values())


def kept(df):
    return sorted(str(r.doc_id) for r in near.keep_one(df).select("doc_id").collect())


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert kept(docs) == sorted(str(min(g)) for g in groups(rows))


def edited(words, share, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def test_recall_at_every_similarity_and_no_false_drop(spark):
    """Pairs of 0.8 to 1: at least 9 of 10 in every tenth below; pairs under 0.8 both stay."""
    rng = random.Random(7)
    data, pairs = [], []
    for n in range(500):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(40, 400))]
        other = edited(words, rng.uniform(0, 0.06), rng)
        data += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
        a, b = sets(data[-2][1]), sets(data[-1][1])
        pairs.append(len(a & b) / len(a | b))
    left = {int(i) for i in kept(spark.createDataFrame(data, "doc_id long, text string").repartition(5))}
    assert all(2 * n in left for n in range(500))
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        mine = [n for n, j in enumerate(pairs) if low <= j < high]
        assert len(mine) > 20
        assert sum(2 * n + 1 not in left for n in mine) >= 0.9 * len(mine)
    assert all(2 * n + 1 in left for n, j in enumerate(pairs) if j < 0.8)


def test_large_dense_groups_give_few_candidates(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(edited(base, 0.01, rng))) for i in range(600)] + [(1000 + i, " ".join(base[:150] + [f"u{i}-{k}" for k in range(150)])) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    left = [int(i) for i in kept(df)]
    assert left == sorted([0, *range(1000, 1300)], key=str)
    described = near.described([t for _, t in data])
    ids = np.arange(len(data))
    low = np.array([np.frombuffer(x, np.uint8) for x in described[3]])
    a, b, _ = near.candidates_of(np.array([k[0] for k in described[2]]), ids, low)
    assert len(a) <= 6 * len(data)


def test_candidates_of_a_key():
    low = np.array([[1] * 70, [1] * 70, [1] * 52 + [2] * 18, [9] * 70], np.uint8)
    a, b, s = near.candidates_of(np.array([5, 5, 5, 5]), np.array([3, 1, 2, 0]), low)
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} >= {(1, 3)} and all(x < y for x, y in zip(a.tolist(), b.tolist())) and 0 not in a
    assert [len(x) for x in near.candidates_of(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 70), np.uint8))] == [0, 0, 0]


def test_awkward(spark):
    df = awkward(spark, 2).withColumns({c: F.lit("mine") for c in ("__row", "__made", "set", "fp", "node", "a", "b", "best", "root")})
    got = near.keep_one(df)
    assert got.columns == df.columns
    rows = [(r[0], r[1]) for r in ROWS * 2]
    want = [min((i is None, i) for i in g)[1] for g in groups(rows)]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, want))
    assert near.keep_one(empty(spark)).count() == 0


def test_texts_stay_where_they_are(spark, tmp_path):
    """The pipeline's findings: whole texts were shuffled twice to pick rows of them, and every table stayed on disk."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    docs = spark.createDataFrame([(i, f"{' '.join(f'w{i // 2}x{j}' for j in range(40))}{' end' * (i % 2)}") for i in range(60)], "doc_id long, text string").repartition(3)
    found = near.keep_one(docs)
    tree = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in tree and "BroadcastHashJoin" in tree
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 60, 2))
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("*/*")} == {"near-marked", "near-kept", "row-bitmaps"}


def test_rows_by_bitmaps_and_by_a_join(spark, monkeypatch):
    numbers = [0, 1, 32767, 32768, 32769, 65536, (1 << 33), (1 << 33) + 1, (1 << 33) + 32768, (1 << 60) + 5]
    table = spark.createDataFrame([(n, str(n)) for n in numbers], "n long, __bits string")
    for some in (numbers[::2], numbers[1::3], numbers, []):
        picked = spark.createDataFrame([(n,) for n in some], "n long")
        for most in (8192, 0):
            monkeypatch.setattr(common, "BITMAPS", most)
            got = common.only_rows(table, picked, "n")
            assert got.columns == table.columns and sorted(r.n for r in got.collect()) == sorted(some)


def test_candidates_within_a_group_and_repeated_links_are_not_joined(spark, monkeypatch):
    """The pipeline's finding: every candidate of a dense group went through joins once more, and a link as often as tasks had found it."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(edited(base, 0.007, rng))) for i in range(500)]
    rows, keep = {}, near.saved

    def counted(df, name, **more):
        out = keep(df, name, **more)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near, "saved", counted)
    assert kept(spark.createDataFrame(data, "doc_id long, text string").repartition(4)) == ["0"]
    assert rows["near-links"] < len(data) and rows["near-apart"] <= rows["near-pairs"]
    between = {"near-pairs", "near-apart", "near-half"}
    assert max(n for name, n in rows.items() if name not in between) <= 1.5 * len(data), rows


def test_candidates_between_groups_are_those_of_different_roots(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, 70))
    low = np.where(rng.random((120, 70)) < 0.12, rng.integers(0, 256, (120, 70)), base[np.arange(120) % 6]).astype(np.uint8)
    keys, root = rng.integers(0, 4, (120, 14)), np.arange(120) // 40
    a, b, s = near.candidates_of(keys.ravel(), np.repeat(np.arange(120), 14), np.repeat(low, 14, 0))
    want = {(x, y, root[x], root[y]) for x, y in zip(a.tolist(), b.tolist()) if root[x] != root[y]}
    nodes = spark.createDataFrame([(i, keys[i].tolist(), bytearray(low[i].tobytes()), int(root[i])) for i in range(120)], "id long, bands array<long>, low binary, root long")
    got = {(r.a, r.b, r.root_a, r.root_b) for r in near.between(nodes).where("a <> b").collect()}
    assert got == want and len(want) > 50
    assert near.between(nodes.withColumn("root", F.lit(7).cast("long"))).count() == 0


def test_salted_joins_with_and_without_frequent_values(spark, monkeypatch):
    rows = spark.createDataFrame([(v, i) for v, n in (("a", 9), ("b", 6), ("c", 2), (None, 4)) for i in range(n)], "v string, i long")
    keyed = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3), (None, 4)], "v string, __n int")
    want = sorted([("a", i, 1) for i in range(9)] + [("b", i, 2) for i in range(6)])
    for frequent, most in ((1000, 10), (5, 10), (5, 1), (0, 2)):
        monkeypatch.setattr(common, "FREQUENT", frequent)
        monkeypatch.setattr(common, "FREQUENT_VALUES", most)
        got = common.salted_join(rows, keyed, "v", "i")
        assert got.columns == ["v", "i", "__n"] and sorted(map(tuple, got.collect())) == want


def test_roots_of_stars_and_chains(spark):
    edges = [(1, 2), (2, 3), (3, 4), (5, 9), (9, 7), (12, 11), (13, 11), (20, 20)]
    got = {(r.node, r.root) for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 4)} | {(n, 5) for n in (5, 7, 9)} | {(n, 11) for n in (11, 12, 13)}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0
