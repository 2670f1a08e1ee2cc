import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import quality, toxicity
from tallystone.llm.queries import op2_quality_classifier, op7_toxicity
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.1"  # enough held-out labels of the rarer kind


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("query", "label", "cut", "least"), [(op2_quality_classifier, "quality", 0.3, 0.9), (op7_toxicity, "toxic", 0.5, 0.95)])
def test_held_out_accuracy(spark, query, label, cut, least):
    out = query(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert out.where((F.col("score") >= cut).cast("int") != F.col("predicted")).count() == 0
    y = rows[label].to_numpy()
    print(label, auc(rows["score"].to_numpy(), y), (rows["predicted"] == y).mean(), len(y))
    assert auc(rows["score"].to_numpy(), y) >= least
    assert (rows["predicted"] == y).mean() >= least


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_awkward(spark, module, label):
    ids = [r[0] for r in ROWS if r[0] is not None]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (99, None)], f"doc_id long, {label} int")
    rows = module.report(awkward(spark), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1 and len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    assert module.report(empty(spark), labels).count() == 0
    none = module.report(awkward(spark), labels.where("false")).collect()
    assert len({r.score for r in none}) == 1
    one = module.report(awkward(spark), labels.where(f"{label} = 1")).collect()
    assert {r.predicted for r in one} == {1}
    scored = module.score(awkward(spark), module.train(awkward(spark), labels))
    assert scored.columns.count("score") == 1


def test_chunks_cover_the_whole_text():
    """A change anywhere in a long text reaches some chunk."""
    rng = np.random.default_rng(0)
    good, bad = ["calm words about rivers and hills. " * 6] * 40, ["buy ### $$$ || now %%% " * 6] * 40
    model = quality.fit(good + bad, np.array([1] * 40 + [0] * 40))
    score = model.scorer()
    base = "calm words about rivers and hills. " * 400
    for at in rng.integers(0, len(base) - 600, 5):
        assert score([base[:at] + "### $$$ || %%% " * 40 + base[at + 600 :]])[0] < score([base])[0]
    assert score([])[:].shape == (0,)


def test_grams_do_not_cross_texts():
    row, slot, _ = toxicity.counted(["abcd", "efgh"])
    alone = [set(toxicity.counted([t])[1].tolist()) for t in ("abcd", "efgh")]
    assert [set(slot[row == k].tolist()) for k in (0, 1)] == alone


def convolved(model, text):
    """The network's probability, one chunk, place and filter at a time."""
    raw = text.encode()
    halves = max(2, -(-(quality.WIDTH + len(raw) + quality.GUARD) // quality.HALF))
    data = bytes(quality.WIDTH) + raw
    data += bytes(halves * quality.HALF + quality.WIDTH - len(data))
    echoed = np.zeros(len(data))
    for at in range(len(data) - 5):
        for lag in range(2, 25):
            if at >= lag and all(data[k] == data[k - lag] for k in range(at, at + 6)):
                echoed[at + 5] = data[at + 5] > 0
    channels = np.array([[float(b in members) for members in quality.CLASSES] for b in data])
    x = np.hstack([channels, echoed[:, None]])
    chunks = []
    for first in range(halves - 1):
        places = range(first * quality.HALF, (first + 2) * quality.HALF, quality.STRIDE)
        z = [np.einsum("wc,wcf->f", x[p : p + quality.WIDTH], model.filters) for p in places]
        chunks.append(np.maximum(np.max(z, axis=0) + model.shift, 0))
    v = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
    return 1 / (1 + np.exp(-(v @ model.weights + model.bias)))


def test_network_against_a_plain_convolution():
    good, bad = ["calm words about rivers and hills. " * 6] * 20, ["buy ### $$$ || now %%% " * 6] * 20
    model = quality.fit(good + bad, np.array([1] * 20 + [0] * 20))
    texts = ["", "short", "na na na na na na na na na", "Ünïcode ###" * 30, "calm words " * 60 + "$$$|| " * 9, "12, (3)\t[4]\n" * 25]
    assert np.allclose(model.scorer()(texts), [convolved(model, t) for t in texts], atol=1e-4)


def slot_of(gram: bytes) -> int:
    """A gram's slot, in plain integers."""
    full, rolled = 2**32 - 1, gram[0]
    for b in gram[1:]:
        rolled = rolled * 0x01000193 & full ^ b
    mixed = (rolled ^ len(gram) * 0x9E3779B1 & full) * 0x85EBCA6B & full
    return ((mixed ^ mixed >> 15) * 0xC2B2AE35 & full) >> 32 - toxicity.BITS


def gram_counts(text):
    counts = {}
    if text:
        data = f" {text.lower()} ".encode()
        for c in b"\t\n\x0b\x0c\r":
            data = data.replace(bytes([c]), b" ")
        for n in toxicity.ORDERS:
            for at in range(len(data) - n + 1):
                s = slot_of(data[at : at + n])
                counts[s] = counts.get(s, 0) + 1
    return {s: min(n, toxicity.CAP) for s, n in counts.items()}


def test_linear_classifier_against_dictionaries():
    good, bad = [f"a kind word to all {i} friends" for i in range(30)], [f"you utter fool number {i} get lost" for i in range(30)]
    texts, y = good + bad, np.array([0] * 30 + [1] * 30)
    model = toxicity.fit(texts, y)
    held = [gram_counts(t) for t in texts]
    ratio = {}
    for s in set().union(*held):
        p, q = (sum(s in h for h, k in zip(held, y, strict=True) if k == side) for side in (1, 0))
        ratio[s] = np.log((1 + p) / 32) - np.log((1 + q) / 32)
    # A weight is learned on the scaled slot, so it keeps the ratio's sign or is small.
    assert set(model.slots.tolist()) <= set(ratio)
    agree = [np.sign(w) == np.sign(ratio[s]) for s, w in zip(model.slots.tolist(), model.weights, strict=True) if abs(w) > 1e-3]
    assert np.mean(agree) > 0.95
    weight = dict(zip(model.slots.tolist(), model.weights.astype(float), strict=True))
    for text in ["", "Kind\tWORD fool", "you utter fool " * 20, "ordinary", "ÜBER friends\nget lost"]:
        z = model.bias + sum(weight.get(s, 0.0) * n for s, n in gram_counts(text).items())
        assert abs(model.scorer()([text])[0] - 1 / (1 + np.exp(-z))) < 1e-5
