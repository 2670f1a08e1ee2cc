import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallystone.llm import personal
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.01"
# The contract's patterns as they stand; quadratic on long runs, so for short texts only.
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def listed(spans):
    return ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def model(spark):
    return personal.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_patterns_in_linear_time_find_what_the_plain_ones_find():
    rng = random.Random(3)
    for alphabet in ("aA1239@@..-+ ()_%x0\n", "1234567890 .-+", "4111 2-", "a.@b-1"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert personal.base_spans(text) == plain(text), text


def test_long_runs_are_read_at_linear_cost(model):
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "(" * 400_000 + "1", "a at b" * 60_000, "+1" + "(" * 400_000):
        personal.spans_of([text], model)


def test_whole_table_against_the_plain_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = personal.report(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert {*filter(None, listed(base).split(","))} <= {*r["spans"].split(",")}


def test_distant_twins_are_found_and_strangers_are_not(model):
    filler = "and then the quiet river ran past the old mill " * 20
    cases = [
        ("Write to anna.berg@mail.example.com today. ", "anna.berg at mail.example.com", "otto.kahn at mail.test.org"),
        ("The server 93.184.216.34 answers. ", "93[.]184[.]216[.]34", "88[.]12[.]201[.]9"),
        ("Paid with 4111 1111 1111 1111 then. ", "4111.1111.1111.1111", "5821.3391.2204.9175"),
        ("Call +1 (132) 555-1352 now. ", "(132) 555-1352", "(787) 443-9921"),
    ]
    for head, twin, stranger in cases:
        text = head + filler + "again " + twin + ", and " + filler + stranger + " too."
        got = [text[s["start"] : s["end"]] for s in personal.spans_of([text], model)[0] if not s["base"]]
        assert got == [twin]
        # Without the first mention nothing links the other spelling to an entity.
        alone = text.replace(head, "")
        assert personal.spans_of([alone], model) == [[]]


def test_consistency_goes_through_a_chain_of_mentions(model):
    text = "Phone +1 (132) 555-1352 here. " + "word " * 50 + "or 1.132.555.1352 there, " + "word " * 50 + "or 555-1352 at last."
    assert [s["kind"] for s in personal.spans_of([text], model)[0]] == ["phone"] * 3


def test_held_out_texts(spark, model):
    """Other spellings of entities of texts outside the sample, and of altered entities."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.length("text") <= personal.MAX_CHARS)
    seen = {r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    texts = [r["text"] for r in docs.where(F.col("text").rlike(r"@mail|\+1 \(")).orderBy("doc_id").collect() if r["text"] not in seen]
    right = missed = wrong = 0
    for n, text in enumerate(texts):
        doc, labels = personal.extended(text, 5000 + n)
        got = dict(model.added(personal.field([doc])))
        for i, (token, label) in enumerate(zip(doc, labels, strict=True)):
            if not token.base:
                guess = got.get(i, -1) + 1
                right, missed, wrong = right + (guess == label > 0), missed + (label > 0 and guess == 0), wrong + (guess not in (0, label))
    assert right + missed > 100
    assert right >= 0.75 * (right + missed) and wrong <= 0.03 * right


def test_beliefs_on_a_tree_are_exact():
    rng = __import__("numpy").random.default_rng(5)
    model = personal.Model(rng.normal(size=(len(personal.FEATURES), personal.LABELS)), rng.normal(size=(3, personal.LABELS, personal.LABELS)))
    model.weights[:, 0] = 0
    token = lambda *picks: personal.Token(0, 1, 0, (True,) * 5, "", "", list(picks))
    f = personal.field([[token(1), token(2, 3), token(4)]])
    own = model.own(f)
    import itertools

    import numpy as np

    joint = np.zeros((5, 5, 5))
    for y in itertools.product(range(5), repeat=3):
        joint[y] = np.exp(sum(own[i, y[i]] for i in range(3)) + model.shared[0, y[0], y[1]] + model.shared[0, y[1], y[2]])
    joint /= joint.sum()
    belief, pair = model.beliefs(f, own)
    assert np.allclose(belief[1], joint.sum((0, 2)), atol=1e-3)
    assert np.allclose(pair[0], joint.sum(2), atol=1e-3)


def test_awkward_rows_and_columns(spark, model):
    docs = awkward(spark).withColumn("spans", F.lit("mine")).withColumn("kind", F.lit("k"))
    got = personal.redact(personal.find(docs, model), model)
    assert got.columns == [*[c for c in docs.columns if c != "spans"], "spans", "redacted"]
    assert got.count() == len(ROWS)
    assert {r["doc_id"]: r["redacted"] for r in got.collect()}[2] == ""
    assert personal.report(awkward(spark)).count() == len(ROWS)
    assert personal.report(empty(spark)).collect() == []
    nothing = personal.fit(["no entity here 12345678901"])
    assert personal.spans_of(["see a@b.cd or a at b.cd"], nothing) == [[{"kind": "email", "start": 4, "end": 10, "base": True}]]


def test_redaction(spark, model):
    df = spark.createDataFrame([(1, "Zoë: zoe@mail.example.com, +1 (132) 555-1352."), (2, None)], "doc_id int, text string")
    assert [r["redacted"] for r in personal.redact(df, model).orderBy("doc_id").collect()] == ["Zoë: [EMAIL], [PHONE].", ""]
