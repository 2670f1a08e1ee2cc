import re
from collections import Counter

from tallystone.llm import rules
from tallystone.llm.queries import op9_quality_rules
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op9_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_repeats(spark):
    texts = ["a b c d e f g h " * 3, "w " * 40, " ".join(map(str, range(30))) + " " + " ".join(map(str, range(5, 20))), "x\n\nx\n x\nx", "a b c d e f g h i a b c d e f g h", "   \x1c a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.with_stats(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_learnt_list_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    print("kept of good", sum(good) / len(good), "kept of bad", sum(bad) / len(bad), len(bad))
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.5


def test_list_covers_in_order(spark):
    """Rows of which one threshold conjunction holds only bad ones: the list finds it."""
    rows = [(i, 100, 500 + i % 50, 60 if i % 4 == 0 else i % 3, 0, 0, int(i % 4 == 0), i % 5 > 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bad int, part boolean")
    found = rules.learn(df)
    assert found
    left = df.where(rules.verdict(found))
    assert left.where("bad = 1").count() == 0 and left.where("bad = 0").count() == 450


def test_awkward(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1)], "doc_id long, quality int")
    rows = rules.report(awkward(spark), labels).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed for r in rows if r.doc_id in (2, 3, 9))
    assert rules.report(empty(spark), labels).count() == 0
    assert rules.report(awkward(spark), labels.where("false")).where("kept = base_failed").count() == 0
