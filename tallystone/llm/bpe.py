"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-pair vocabulary are compiled, one after another, into the
transition table of a deterministic automaton over token labels that accepts
correct tokenizations only. Before the first merge there is one state with a loop
for every byte. The gadget of a merge (u, v) -> w sends u to a state without the
arc v and adds an arc w to where v led; what leaves the state after w is a copy of
what leaves the state after v, and the arc w leaves every state that the arc u
leaves. So each label's arcs lead to one state, named by the label, and the gadget
clears the arc v of u's state, of all states copied from it afterwards, and for all
arcs added beside v's afterwards. With states in the order of a walk over who
was copied from whom, latest copies first, and labels likewise, both sets are
runs, so each gadget clears a rectangle of the table. States with equal
rows are one. A word's last label has the word end's suffix, after which nothing
follows.

Encoding runs over a word's prefixes: exactly one label can end at each prefix,
namely the one whose arc leaves the state of the prefix before it, which is a
look at the table. Decoding emits the arcs' labels.

Merges have to be those of a trained vocabulary: every one applies to its own
label's letters (tested for the file used).

Defined cases: null and empty texts have no tokens, and digests of the empty
string; repeated rows encode alike; a text of one very long word takes time in
proportion to its length; an empty table gives no rows; columns named as results
are replaced, ignoring case, and others are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallystone.llm.common import with_arrow

#: Words remembered by a worker at most, some 90 MB, and states compiled at once.
WORDS, BLOCK = 300_000, 1024
#: White space by the Unicode property.
SPACES = "\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
FIELDS = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def walk(parent: dict[int, tuple[int, int]], order: list[int]) -> tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]:
    """Places of 0 to n - 1, each followed by its copies, latest first; where each one's copies end; and copies by age.

    ``parent`` says from whom and when each was copied; those copied from none come as in ``order``.
    """
    copies: dict[int, list[tuple[int, int]]] = {}
    for child, (origin, when) in sorted(parent.items(), key=lambda x: -x[1][1]):
        copies.setdefault(origin, []).append((when, child))
    place, end, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), 0
    stack = [(i, False) for i in reversed(order) if i not in parent]
    while stack:
        node, done = stack.pop()
        if done:
            end[node] = at
            continue
        place[node], at = at, at + 1
        stack.append((node, True))
        stack += [(child, False) for _, child in reversed(copies.get(node, []))]
    return place, end, copies


def run_end(node: int, since: int, place: np.ndarray, end: np.ndarray, copies: dict[int, list[tuple[int, int]]]) -> int:
    """Where the run of a node and its copies made at ``since`` or later ends."""
    made = copies.get(node, [])
    k = bisect_right(made, -since, key=lambda x: -x[0])  # latest first
    return int(end[made[k - 1][1]] if k else place[node] + 1)


class Automaton:
    """The transition table of a vocabulary: a state for each label that a word can go on after."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix = vocab, suffix
        self.labels = {i: s for s, i in vocab.items()}
        gadgets = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        n = max(vocab.values()) + 1
        last = np.zeros(n, bool)  # words end with these, copies of such ones too, so their states need no rows
        last[[i for s, i in vocab.items() if s.endswith(suffix)]] = True
        states = walk({w: (v, t) for t, (_, v, w) in enumerate(gadgets)}, np.argsort(last, kind="stable").tolist())
        labels = walk({w: (u, t) for t, (u, _, w) in enumerate(gadgets)}, list(range(n)))
        # The state after w is copied before its own gadget's arc is cleared, the arc w after.
        cleared = np.array([(states[0][u], run_end(u, t + 1, *states), labels[0][v], run_end(v, t, *labels)) for t, (u, v, _) in enumerate(gadgets)]).reshape(-1, 4)
        self.column, self.row, rows = labels[0].tolist(), [0] * n, {}
        self.stride, at_place = -(-n // 8), np.argsort(states[0])[: n - last.sum()]
        for a in range(0, len(at_place), BLOCK):
            block = np.ones((min(BLOCK, len(at_place) - a), n), np.uint8)
            for top, bottom, left, right in cleared[(cleared[:, 0] < a + BLOCK) & (cleared[:, 1] > a)].tolist():
                block[max(0, top - a) : max(0, bottom - a), left:right] = 0
            for state, bits in zip(at_place[a : a + BLOCK].tolist(), np.packbits(block, axis=1, bitorder="little"), strict=True):
                self.row[state] = rows.setdefault(bits.tobytes(), len(rows)) * self.stride
        self.table = b"".join(rows)
        self.letters_of: dict = {}  # trie of labels: letter -> node, "" -> label, suffix -> label at a word's end
        for label, i in vocab.items():
            plain = label.removesuffix(suffix)
            node = self.letters_of
            for letter in plain:
                node = node.setdefault(letter, {})
            node[suffix if plain != label else ""] = i

    def arc(self, state: int, label: int) -> bool:
        """Does the state after ``state`` have an arc ``label``?"""
        column = self.column[label]
        return self.table[self.row[state] + (column >> 3)] >> (column & 7) & 1 > 0

    def path(self, word: str) -> list[int]:
        """Labels of the one accepted path that spells ``word`` (byte letters), the last with the suffix."""
        n, suffix = len(word), self.suffix
        table, rows, columns, row = self.table, self.row, self.column, 0
        ends: list[int] = [-1] * (n + 1)
        widths = [0] * (n + 1)
        for j in range(n):
            node = self.letters_of
            if j:
                row = rows[ends[j]]
            for i in range(j + 1, n + 1):
                node = node.get(word[i - 1])
                if node is None:
                    break
                if ends[i] < 0:  # one label at most ends a prefix, so the first found is it
                    label = node.get("" if i < n else suffix)
                    if label is not None and (j == 0 or table[row + (columns[label] >> 3)] >> (columns[label] & 7) & 1):
                        ends[i], widths[i] = label, i - j
        out, i = [], n
        while i > 0:
            out.append(ends[i])
            i -= widths[i]
        return out[::-1]


class _Words(dict):
    """Word -> its ids as joined text; emptied when full, so memory is bounded."""

    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, word: str):
        if len(self) >= WORDS:
            self.clear()
        path = self.coder.automaton.path("".join([self.coder.letters[b] for b in word.encode("utf-8", "surrogatepass")]))
        got = " ".join(map(str, path))
        if len(word) < 200:
            self[word] = got
        return got


class Coder:
    """Normalises, splits and encodes as a tokenizer file with word ends describes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.label_of = labels | {str(i): s for i, s in labels.items()}  # ids as numbers or digits
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACES))
        plain = split["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9")
        self.plain_words = re.compile(plain.replace(r"\s", "\t-\r "))
        self.spaces = re.compile(f"[{SPACES}]+")
        self.known = _Words(self)

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if text.isascii():
            return self.plain_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Each letter is lowered by itself: a final sigma stays as any other.
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        return self.words.findall(text)

    def encoded(self, text: str) -> str:
        """The ids of a text, joined by spaces."""
        known, out = self.known, []
        parts = self.specials.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                out += [known[w] for w in self.split(part)]
        return " ".join(out)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encoded(text or "").split()]

    def decode(self, ids: list[int] | list[str]) -> str:
        """The labels of the arcs, joined by spaces as a tokenizer without a decoder joins them."""
        return " ".join(map(self.label_of.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids and of what they decode to."""
        joined = self.encoded(text)
        ids = joined.split()
        return (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest())


@lru_cache(2)
def coder(path: str) -> Coder:
    """One compiled coder a worker and vocabulary."""
    return Coder(path)


def encode(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append ``ids``, the token ids of each whole text."""
    return with_arrow(documents, text, [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], lambda: lambda texts: [[coder(path).encode(t) for t in texts]])


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded``, the text that each row's ids give; null for null."""
    base = tokens.drop("decoded")
    schema = T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        of = coder(path)
        for batch in batches:
            new = [None if x is None else of.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], schema.names)

    return base.mapInArrow(run, schema)


def with_digests(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append the number of tokens and the digests of ids and decoded text."""

    def make():
        of = coder(path)
        return lambda texts: [list(c) for c in zip(*map(of.digests, texts), strict=True)] if texts else [[], [], []]

    return with_arrow(documents, text, FIELDS, make)


def with_round_trip(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append ids, the number of tokens, and the digests of ids and of the text decoded from them."""
    fields = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), *FIELDS]

    def make():
        of = coder(path)

        def run(texts: list[str]) -> list[list]:
            ids = [of.encoded(t).split() for t in texts]
            joined = [hashlib.sha256(" ".join(x).encode()).hexdigest() for x in ids]
            return [[list(map(int, x)) for x in ids], [len(x) for x in ids], joined, [hashlib.sha256(of.decode(x).encode()).hexdigest() for x in ids]]

        return run

    return with_arrow(documents, text, fields, make)


def report(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the digest columns of every document."""
    return with_digests(documents.select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
