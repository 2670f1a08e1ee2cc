import corpus_pipeline
from tests.llm.fixtures import awkward, empty
from tests.llm.test_classifiers import gram_counts
from tests.llm.test_mixing import WORD, by_hand
from tests.llm.test_near import groups
from tests.llm.test_suffixes import brute as cuts

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on its own input: what goes, what stays, what is cut, how often, which tokens."""
    import hashlib

    from tokenizers import Tokenizer

    from tallystone.llm import toxicity
    from tallystone.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    calm = stage["toxicity"](spark, docs, SF).cache()
    assert calm.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.slots.tolist(), model.weights.astype(float), strict=True))
    bad = {r.doc_id for r in docs.collect() if model.bias + sum(weight.get(s, 0.0) * n for s, n in gram_counts(r.text or "").items()) >= 0}
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in docs.collect()} - bad

    single = stage["simhash_near_dedup"](spark, calm, SF).cache()
    rows = [(r.doc_id, r.text) for r in calm.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups(rows))
    assert single.columns == docs.columns

    cut = stage["suffix_array_dedup"](spark, single, SF).cache()
    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = {i: digest for i, _, _, _, digest in cuts(rows)}
    for r in cut.collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id]
        assert r.n_chars == len(r.text or "")
    assert cut.count() == len(rows) and cut.columns == docs.columns

    mixed = stage["mixing"](spark, cut, SF).cache()
    assert mixed.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs_of = {r.doc_id: (r.text, r.source) for r in cut.collect()}
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in docs_of.items()}
    want = {i: -(-n // size[i]) if size[i] else 0 for i, n in by_hand(docs_of, labels).items()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}

    out = stage["bpe"](spark, mixed, SF)
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    texts = {r.doc_id: r.text for r in cut.collect()}
    for r in out.collect():
        assert list(r.ids) == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and "ids_sha256" in rows.columns


def test_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, repeats, odd texts, clashing names and no rows at all pass through all stages."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert rows.count() == 0 if name == "empty" else rows.count() > 0
