import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallystone.llm import divergence
from tests.llm.fixtures import awkward, empty
from tests.oracle import differences

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=50):
    """(lang, source, part, item, value, rank) over the dense table, in Python's own integers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_sql_on_a_whole_table(spark):
    assert differences(divergence.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), divergence.oracle(), "/root/testdata/sf0.001") == []


def rows(spark, data):
    return spark.createDataFrame(data, "text string, lang string, source string").repartition(3)


DATA = (
    [(f"Common words here, no{i % 3} Übung ÜBUNG über x{i}y", "de", f"s{i % 5}") for i in range(90)]
    + [("common COMMON tie1 tie2 tie3 tie4", "de", "s9")] * 31
    + [(None, "de", "mute"), ("", "de", None), ("only one", "xx", "alone"), ("1234 ... !", None, "a"), (None, None, "b"), (None, None, None)]
    + [("日本 語 Ⅷ \x00nul\x7fdel İstanbul", "ja", s) for s in ("p", "q")] * 20
)


def test_brute_force_with_nulls_ties_and_repeats(spark):
    assert got(rows(spark, DATA)) == brute(DATA)


def test_other_bounds_and_a_third_of_all_rows_in_one_group(spark):
    data = DATA + [("a b c d e f g h " * 3 + str(i), "de", "s0") for i in range(120)]
    assert got(rows(spark, data), least_docs=3, top=2) == brute(data, 3, 2)


def test_long_texts_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 200)
    monkeypatch.setattr(divergence, "SHARD_ROWS", 20)
    data = DATA + [("long word " * 50_000, "de", "s1")]
    assert got(rows(spark, data)) == brute(data)


def test_empty_awkward_and_clashing(spark):
    assert divergence.report(empty(spark)).collect() == []
    df = awkward(spark, 12)
    plain = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    assert got(df) == brute(plain)
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("term", "n", "docs", "v", "p0", "item", "value", "rank", "total")])
    assert got(clashing) == brute(plain)
