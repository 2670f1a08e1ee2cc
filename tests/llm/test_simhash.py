import numpy as np
import xxhash

from tallystone.llm import simhash
from tallystone.llm.queries import op8_simhash
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = [w.decode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().translate(None).split()]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted((str(i), f"{fp:016x}", names.get(find(k))) for k, (i, fp) in enumerate(fps))


def mine(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert mine(op8_simhash(spark, SF)) == brute(docs)


def test_awkward(spark):
    assert mine(simhash.report(awkward(spark))) == brute([r[:2] for r in ROWS])
    assert simhash.report(empty(spark)).count() == 0


def test_golay_keys_meet_within_the_bound():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63, 400, np.int64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[k] ^= np.int64(-(2**63)) if bit == 63 else np.int64(1) << np.int64(bit)
    tables = simhash.golay_tables()
    keys = []
    for side in (a, b):
        row, key = simhash.fuzzy_keys(side, tables)
        held = [set() for _ in side]
        for r, x in zip(row.tolist(), key.tolist(), strict=True):
            held[r].add(x)
        keys.append(held)
    assert all(x & y for x, y in zip(*keys, strict=True))


def test_links_of_chains_and_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    chain = [int(rng.integers(0, 2**62))]
    for _ in range(150):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(62, 4, replace=False)))
    centre = int(rng.integers(0, 2**62))
    dense = [centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    alone = [int(x) for x in rng.integers(0, 2**62, 200)]
    values = list(dict.fromkeys(chain + dense + alone))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.component_of(df).collect()}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert all(got[v] == find(i) for i, v in enumerate(values))


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(awkward(spark))
    ids = sorted(str(r.doc_id) for r in kept.select("doc_id").collect())
    assert ids == sorted(str(i) for i in {c if c is not None else i for i, _, c in brute([r[:2] for r in ROWS])}) and kept.columns == awkward(spark).columns
