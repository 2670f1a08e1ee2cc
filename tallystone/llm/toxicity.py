"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 5 to 8 bytes of the lower-cased text, white space
taken as one kind of blank, hashed to 2^22 slots; a text's value for a slot is its count, which saturates
at CAP. A slot's scale is its naive Bayes log-count ratio between the two classes;
logistic regression learns one weight for each scaled slot. Scoring is linear: a
text's score is the sigmoid of the summed weights of the n-grams anywhere in it.

Defined cases: null and empty texts hold no n-gram and score the bias alone;
repeated rows score alike; with labels of one kind only, or none, the score is
that constant rate (0 without labels); an empty table gives no rows; very long
texts are scored whole, though those above MAX_CHARS are not learnt from; columns
named as results are replaced, others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import held_out, labelled_sample, with_arrow, without

BITS = 22
ORDERS = (5, 6, 7, 8)
#: Bound of the fitted sample: rows of each label, and characters of a row.
PER_CLASS, MAX_CHARS = 2400, 20_000
#: The model's shape, the same at every size of the corpus: how many slots it has weights
#: for, in how many sampled texts a slot must occur, and where an n-gram's count saturates.
KEEP, LEAST_DOCS, CAP = 4_000, 8, 6
THRESHOLD = 0.5
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Hash slots of all n-grams of the bytes, one array an order, by start."""
    out, h = [], data.astype(np.uint32)
    rolled = h.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            out += [np.zeros(0, np.uint32)] * (n in ORDERS)
            continue
        rolled = rolled[: len(data) - n + 1] * np.uint32(0x01000193) ^ h[n - 1 :]
        if n in ORDERS:
            mixed = (rolled ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts one after another, and where each begins."""
    raw = [f" {t.lower()} ".encode("utf-8", "surrogatepass").translate(BLANKS) if t else b"" for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=starts[1:])
    return np.frombuffer(b"".join(raw), np.uint8), starts


def counted(texts: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs and their counts up to CAP; with a table, of the slots that it marks."""
    data, starts = joined(texts)
    found = []
    for n, slot in zip(ORDERS, grams(data), strict=True):
        at = np.flatnonzero(table[slot]) if table is not None else np.arange(len(slot))
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + n <= starts[row + 1]
        found.append((row[inside] << BITS) | slot[at[inside]].astype(np.int64))
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), np.minimum(n, CAP)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        table = np.zeros(1 << BITS, np.float32)
        table[self.slots] = self.weights

        def score(texts: list[str]) -> np.ndarray:
            row, slot, n = counted(texts, table)
            z = self.bias + np.bincount(row, table[slot] * n, len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score


def fit(texts: list[str], y: np.ndarray, steps: int = 300, l2: float = 1e-2) -> Model:
    """Ratios by counting documents, then logistic regression with Adam on the scaled slots.

    The sample is read twice, first for the ratios, then for the kept slots, so
    memory holds the kept slots' pairs only.
    """
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -30.0 if not y.any() else 30.0)
    if len(set(y.tolist())) < 2:
        return none
    docs = np.zeros((2, 1 << BITS), np.int32)
    blocks = [slice(at, at + 20) for at in range(0, len(texts), 20)]
    for block in blocks:
        row, slot, _ = counted(texts[block])
        for k in (0, 1):
            np.add.at(docs[k], slot[y[block][row] == k], 1)
    seen = np.flatnonzero(docs.sum(0, dtype=np.int32) >= max(1, min(LEAST_DOCS, 1 + y.sum() // 2)))
    q, p = docs[:, seen]
    del docs
    ratio = np.log((1 + p) / (2 + y.sum())) - np.log((1 + q) / (2 + (1 - y).sum()))
    evidence = np.abs(ratio) * np.sqrt(p + q)
    best = np.sort(np.argsort(-evidence, kind="stable")[:KEEP])
    best = best[evidence[best] > 0]
    kept, scale = seen[best], ratio[best]
    mark = np.zeros(1 << BITS, bool)
    mark[kept] = True
    pairs = [((r + block.start).astype(np.int32), s.astype(np.int32), n.astype(np.int32)) for block in blocks for r, s, n in [counted(texts[block], mark)]]
    row, slot, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
    col = np.searchsorted(kept, slot)
    value = scale[col] * n
    w, b = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col] * value, len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(y)
        g = np.append(np.bincount(col, err[row] * value, len(kept)) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(kept, (w * scale).astype(np.float32), float(b))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the bounded sample that ``labelled_sample`` describes."""
    return fit(*labelled_sample(documents, labels, label, PER_CLASS, MAX_CHARS))


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """Append ``score`` and ``predicted``; columns of these names are replaced."""

    def make():
        scorer = model.scorer()
        return lambda texts: [scorer(texts).tolist()]

    name, decided = f"{prefix}score", f"{prefix}predicted"
    out = with_arrow(without(documents, [decided]), text, [(name, T.DoubleType(), pa.float64())], make)
    return out.withColumn(decided, (F.col(name) >= threshold).cast("int"))


def drop_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the model does not reject, with their own columns only."""
    prefix = "__toxicity_"
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix += "_"
    kept = score(documents, model, text, prefix=prefix)
    return kept.where(F.col(f"{prefix}predicted") == 0).drop(f"{prefix}score", f"{prefix}predicted")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(documents, labels)
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
