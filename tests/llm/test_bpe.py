import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallystone.llm import bpe
from tallystone.llm.queries import op4_bpe, tokenizer_path
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.001"
ODD = ["İstanbul ǅ ŉ", "é Å ﬁ", " a b​c﻿", "<|startoftext|>x<|endoftext|>", "<|endoftext|", "'s 'S ' ''", "²³½ ٣٤ Ⅷ", "퟿\U0010ffff", "a­b", "ΣΑΣ σς", "x" * 3000, "1234567890" * 50, "\t\n\x0b\x1c\x1d\x1e\x1f\x85", "don't WE'LL I'd", "!!!???...,,,;;;", "न्‍यू दिल्ली", "가각힣 가"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_awkward_texts(library):
    mine = bpe.coder(tokenizer_path())
    for text in ODD + [r[1] or "" for r in ROWS]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text[:60]
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False), text[:60]


def test_query_matches_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op4_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_label_spells_itself():
    automaton = bpe.coder(tokenizer_path()).automaton
    ends = {s: i for s, i in automaton.ids.items() if s.endswith(automaton.suffix)}
    assert len(ends) > 30_000
    assert all(automaton.path(s.removesuffix(automaton.suffix)) == [i] for s, i in ends.items())


def by_copies(vocab, merges):
    """The table as the gadgets build it: one row and one column copied for each merge."""
    n = len(vocab)
    table = np.zeros((n, n), bool)
    base = [i for s, i in vocab.items() if len(s.removesuffix("$")) == 1]
    table[np.ix_(base, base)] = True
    for u, v in merges:
        a, b, w = vocab[u], vocab[v], vocab[u + v]
        table[w] = table[b]
        table[a, b] = False
        table[:, w] = table[:, a]
    return table


def test_table_is_what_successive_gadgets_build():
    letters = ["a", "b", "c"]
    merges = [("a", "b"), ("a", "a"), ("b", "c$"), ("ab", "ab"), ("aa", "a"), ("c", "ab"), ("b", "b"), ("bb", "bb"), ("aa", "bc$"), ("c", "c$"), ("abab", "c$"), ("b", "a")]
    vocab = {s: i for i, s in enumerate(letters + [x + "$" for x in letters] + [u + v for u, v in merges])}
    automaton, table = bpe.Automaton(vocab, merges, "$"), by_copies(vocab, merges)
    for s, i in vocab.items():
        if not s.endswith("$"):
            assert [automaton.arc(i, j) for j in range(len(vocab))] == table[i].tolist(), s


def merged(word, ranks):
    """Byte-pair merging by hand."""
    parts = [*word[:-1], word[-1] + "$"]
    while True:
        found = min(((ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if found is None:
            return parts
        k = found[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_automaton_spells_as_merging_does():
    rng = np.random.default_rng(3)
    alphabet = "abcd"
    words = ["".join(rng.choice(list(alphabet), int(rng.integers(1, 9)))) for _ in range(400)]
    merges, corpus = [], [[*w[:-1], w[-1] + "$"] for w in words]
    for _ in range(60):  # a vocabulary whose merges all apply
        counts = Counter(p for c in corpus for p in zip(c, c[1:]))
        best = min(counts, key=lambda p: (-counts[p], p))
        merges.append(best)
        corpus = [merged(w, {p: i for i, p in enumerate(merges)}) for w in words]
    vocab = {s: i for i, s in enumerate([*alphabet, *[x + "$" for x in alphabet], *dict.fromkeys(u + v for u, v in merges)])}
    automaton, ranks = bpe.Automaton(vocab, merges, "$"), {p: i for i, p in enumerate(merges)}
    for word in {"".join(rng.choice(list(alphabet), int(rng.integers(1, 14)))) for _ in range(3000)}:
        assert [automaton.labels[i] for i in automaton.path(word)] == merged(word, ranks), word


def test_defined_cases(spark):
    assert bpe.report(empty(spark), tokenizer_path()).count() == 0
    rows = bpe.report(awkward(spark), tokenizer_path()).collect()
    assert len(rows) == len(ROWS)
    none = [r for r in rows if r.doc_id in (2, 3)]
    assert {(r.n_tokens, r.ids_sha256) for r in none} == {(0, hashlib.sha256(b"").hexdigest())}
    out = bpe.decode(bpe.encode(awkward(spark), tokenizer_path()), tokenizer_path())
    assert out.columns.count("ids") == 1 and out.where("doc_id = 10").first().decoded == "word</w>"
