import math
import re
import struct
import zlib

import pytest
import xxhash

from tallystone.llm import mixing
from tallystone.llm.queries import op6_mixing
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()}
    rows = op6_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(WORD.findall(d.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[d.source] = sizes.get(d.source, 0) + r.size
        taken[d.source] = taken.get(d.source, 0) + r.taken
        target[d.source] = r.target
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    assert sum(target.values()) == pytest.approx(min(sum(sizes.values()), 3 * sum(sizes.values())))
    for s in order:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * sizes[s] + 1e-6
    assert {r.source_size for r in rows if docs[r.doc_id].source == order[0]} == {sizes[order[0]]}
    again = {(r.doc_id, r.taken) for r in op6_mixing(spark, SF).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def draw(doc_id):
    """The document's uniform number, by the hash library."""
    first = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
    return (xxhash.xxh64_intdigest(str(doc_id).encode(), first) % 2**52 + 0.5) / 2**52


def by_hand(docs, labels):
    """Sizes, bands, weights, keys sorted within each source, and prefix sums."""
    size, band = {}, {}
    for i, (text, _) in docs.items():
        n = size[i] = len(WORD.findall(text or ""))
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        band[i] = (min(40, 2 * len(text) // n + 1), min(20, int(2 * math.log2(1 + 1000 * symbols / len(text))) + 1)) if n else (0, 0)
    known = [(band[i], y) for i, y in labels.items() if i in docs and y in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    n_of = [sum(y == k for _, y in known) for k in (0, 1)]

    def odds(f, b, last):
        share = [(1 + sum(y == k and x[f] == b for x, y in known)) / (n_of[k] + last + 1) for k in (0, 1)]
        return math.log(share[1] / share[0])

    chance = {b: 1 / (1 + math.exp(-(math.log(n_of[1] / n_of[0]) + odds(0, b[0], 40) + odds(1, b[1], 20)))) for b in set(band.values())}
    total, taken = {}, {}
    for i, (_, s) in docs.items():
        total[s] = total.get(s, 0) + size[i]
    goal = mixing.targets(total)
    for s in total:
        if not total[s]:
            taken |= {i: 0 for i in docs if docs[i][1] == s}
            continue
        epochs, rest = divmod(round(goal[s]), total[s])
        for i in sorted((i for i in docs if docs[i][1] == s), key=lambda i: (-math.log(draw(i)) / max(0.1, chance[band[i]]), str(i))):
            taken[i] = epochs * size[i] + min(rest, size[i])
            rest -= min(rest, size[i])
    return taken


@pytest.mark.parametrize("ordered", [1000, 5])
def test_query_matches_sorting_by_hand(spark, monkeypatch, ordered):
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    monkeypatch.setattr(mixing, "PIECES", 32 if ordered > 5 else 4)
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {r.doc_id: r.taken for r in op6_mixing(spark, SF).collect()} == by_hand(docs, labels)


def test_equal_rows_take_equally(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED", 3)
    df = spark.createDataFrame([(1, "a b c d", "s")] * 30 + [(2, "e f", "t")] * 30, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len({r.taken for r in rows if r.source == "s"}) == 1 and len(rows) == 60


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, 2, 3)], "doc_id long, text string, source string, row int, u int, key int")
    assert mixing.mix(df).columns == [*df.columns, *mixing.RESULTS]


def test_targets_reshare_the_excess():
    got = mixing.targets({"a": 1000, "b": 10, "c": 1000, "d": 1000, None: 5})
    assert got["b"] == 30 and got[None] == 15
    assert got["c"] == pytest.approx(3 * got["a"]) and got["d"] == pytest.approx(got["a"]) and sum(got.values()) == pytest.approx(3015)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_higher_quality_is_taken_more_often(spark):
    """Inclusion rises with the weight: sampling is by exponential keys scaled by it."""
    rows = [(i, "good words have a usual length here" if i % 2 else "a b c d e f g", "s" if i < 4000 else "t") for i in range(8000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 8000, 3)], "doc_id long, quality int")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels).where("source = 's'").collect()
    good, bad = ([r.taken for r in out if r.doc_id % 2 == k] for k in (1, 0))
    assert sum(good) / len(good) > 1.2 * sum(bad) / len(bad)


def test_awkward(spark):
    rows = mixing.report(awkward(spark)).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    assert all((r.size, r.taken) == (0, 0) for r in rows if r.doc_id in (2, 3, 9))
    assert mixing.report(empty(spark)).count() == 0
    mixed = mixing.mixed(awkward(spark))
    assert "words" in mixed.columns
