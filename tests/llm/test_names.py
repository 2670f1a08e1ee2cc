"""A user's columns keep their names and values, whatever the operators call theirs."""

from pyspark.sql import functions as F

from tallystone.llm import rules, suffixes, toxicity
from tests.llm.fixtures import ROWS, awkward


def with_names(df, names):
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def check(df, docs, names):
    assert set(docs.columns) - {"text"} <= set(df.columns)
    assert all(r[n] == "mine" for r in df.collect() for n in names)


def test_statistics(spark):
    names = ["__h", "__words", "__lines", "__at", "__own", "__any", "__text"]
    docs = with_names(awkward(spark), names)
    got = rules.with_stats(docs)
    assert got.count() == len(ROWS)
    check(got, docs, names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, quality int")
    assert rules.report(docs, labels).count() == len(ROWS)


def test_cut_repeats(spark):
    names = ["__kept", "__kept_", "__t", "raw", "keep"]
    docs = with_names(awkward(spark), names)
    got = suffixes.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(ROWS)
    check(got, docs, names)


def test_toxicity(spark):
    names = ["__toxicity_score", "__TOXICITY_predicted", "__toxicity__score"]
    docs = with_names(awkward(spark), names)
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, toxic int"))
    got = toxicity.drop_toxic(docs, model)
    assert got.columns == docs.columns
    check(got, docs, names)
