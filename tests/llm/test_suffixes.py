import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import suffixes
from tallystone.llm.queries import op5_suffix_dedup
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.001"
LAST = 1 << 62


def brute(rows):
    """Every 50-byte string's smallest id, then the bytes covered by those of larger ids."""
    least = {}
    raws = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for at in range(len(raw) - 49):
            s = raw[at : at + 50]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 49):
            if least[raw[at : at + 50]] < i:
                gone[at : at + 50] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((-1 if i == LAST else i, len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def mine(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert mine(op5_suffix_dedup(spark, SF)) == brute(docs)


def test_awkward(spark):
    assert mine(suffixes.report(awkward(spark))) == brute([r[:2] for r in ROWS])
    assert suffixes.report(empty(spark)).count() == 0


@pytest.mark.parametrize("range_bytes", [16 << 20, 100])
def test_planted_passages(spark, monkeypatch, range_bytes):
    # Ranges of 100 bytes put boundaries inside most groups of equal windows.
    monkeypatch.setattr(suffixes, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(suffixes, "MAX_PARTITIONS", 7)
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    word = lambda n: rng.choice(letters, n).tobytes().decode()
    shared = [word(n) for n in (49, 50, 51, 75, 76, 200)]
    rows = []
    for i in range(120):
        body = word(int(rng.integers(0, 120)))
        for s in rng.choice(len(shared), 2):
            body += shared[s] + word(int(rng.integers(0, 30)))
        rows.append((i % 100, body + "ab" * (i % 50)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert mine(suffixes.report(df)) == brute(rows)


def test_frequent_passage_spreads_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 2000)
    rng = np.random.default_rng(8)
    word = lambda n: rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), n).tobytes().decode()
    passage = word(60)
    rows = [(i, word(40) + passage + word(40)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert mine(suffixes.report(df)) == brute(rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a" * 60, "kept"), (2, "a" * 60, "too")], "doc_id long, text string, __t string")
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "a" * 60, "kept"), (2, "", "too")]


@pytest.mark.parametrize("kinds", [2, 256])
def test_words_sort_as_bytes(kinds):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, kinds, (500, 19)).astype(np.uint8)
    rows[100:200] = rows[:100]
    order, common = suffixes.in_order(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(got)
    for k in range(1, 500):
        n = next((j for j in range(19) if got[k][j] != got[k - 1][j]), 19)
        assert common[k] == n


def test_texts_without_repeats(spark):
    docs = awkward(spark)
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.where("doc_id = 2").first().text is None
    assert out.where("doc_id = 5").first().text == ROWS[4][1]
    assert "An ending of its own." in out.where("doc_id = 7").first().text
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
