"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes become vectors: every byte value has a learned embedding, which
training starts from the byte's class and moves by gradients like any weight, and
an echo channel tells that the byte ends a stretch of at least six bytes that
repeats what stood 2 to 24 bytes before. Learned filters of 8 bytes slide over them with a stride of 4 and pass
a rectifier. Chunks of 256 bytes overlap by half and cover the whole text; each
chunk max-pools every filter. A text's vector is the maximum and the mean of its
chunks' pooled values, and a logistic unit combines it into one probability.

Defined cases: null and empty texts are one chunk of padding and get that
chunk's score; repeated rows score alike; with one label only, or none, every
score is that label (1 without labels, as nothing speaks against a text); an empty
table gives no rows; very long texts are scored whole, though those above
MAX_CHARS are not learnt from; columns named as results are replaced, others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import held_out, labelled_sample, with_arrow, without

WIDTH, STRIDE, CHUNK, FILTERS = 8, 4, 256, 16
HALF = CHUNK // 2
GUARD = 32  # zero bytes between texts: more than an echo's reach of 24 + 5 and a filter's of 8
#: Bound of the fitted sample: rows of each label, and characters of a row.
PER_CLASS, MAX_CHARS = 1200, 12_000
THRESHOLD = 0.3
#: Byte classes: where the embeddings start, each class a component; byte values of a class part in training.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"aeiou", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b"|", b"#*$%&<>", b".,;:!?", b"@/\\_=+~^`", b"()[]{}\"'-", bytes(range(128, 256)), bytes(1))
CHANNELS = len(CLASSES) + 1


def class_table() -> np.ndarray:
    table = np.zeros((256, len(CLASSES)), np.float32)
    for i, members in enumerate(CLASSES):
        table[list(members), i] = 1
    return table


def echo(data: np.ndarray) -> np.ndarray:
    """1 where a stretch of six bytes or more repeats the bytes 2 to 24 before; zero bytes repeat nothing."""
    data = np.concatenate([np.zeros(GUARD, np.uint8), data])
    out = np.zeros(len(data), bool)
    for lag in range(2, 25):
        same = data[lag:] == data[:-lag]
        if len(same) < 6:
            break
        two = same[1:] & same[:-1]
        four = two[2:] & two[:-2]
        six = four[2:] & two[:-4]
        out[lag + 5 :] |= six
    return (out & (data > 0))[GUARD:]


def laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each text padded to whole half chunks, two at least; half chunks of each text.

    WIDTH zero bytes begin a text and GUARD at least end it, so no filter and no echo reaches from one text to another.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    halves = np.array([max(2, -(-(WIDTH + len(r) + GUARD) // HALF)) for r in raw], np.int64)
    data = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    at = 0
    for r, n in zip(raw, halves.tolist(), strict=True):
        data[at + WIDTH : at + WIDTH + len(r)] = np.frombuffer(r, np.uint8)
        at += n * HALF
    return data, halves


def chunk_starts(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First half of every chunk, and where each text's chunks begin."""
    ends = np.cumsum(halves)
    is_last = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    is_last[ends - 1] = True
    chunks = np.flatnonzero(~is_last)
    return chunks, np.concatenate([[0], np.cumsum(halves - 1)])[:-1].astype(np.int64)


@dataclass
class Model:
    embeddings: np.ndarray  # (256, CHANNELS - 1)
    filters: np.ndarray  # (WIDTH, CHANNELS, FILTERS)
    shift: np.ndarray
    weights: np.ndarray  # maxima, then means
    bias: float

    def scorer(self):
        per_byte = np.stack([self.embeddings @ self.filters[j, :-1] for j in range(WIDTH)]).astype(np.float32)
        # Tables of byte pairs halve the lookups: (WIDTH / 2, 65536, FILTERS), a fixed size.
        pairs = np.stack([(per_byte[j][:, None, :] + per_byte[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)])
        for_echo = self.filters[:, -1, :].astype(np.float32)
        steps = HALF // STRIDE

        def score(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros(0)
            data, halves = laid(texts)
            repeated = echo(data)
            n, block = int(halves.sum()), 512
            pooled = np.empty((n, FILTERS), np.float32)
            for a in range(0, n, block):
                b = min(n, a + block)
                piece = data[a * HALF : b * HALF + WIDTH]
                two = piece[:-1].astype(np.int32) << 8 | piece[1:]
                count = (b - a) * steps
                z = pairs[0][two[0 : count * STRIDE : STRIDE]]
                for j in range(1, WIDTH // 2):
                    z += pairs[j][two[2 * j : 2 * j + count * STRIDE : STRIDE]]
                again = repeated[a * HALF : b * HALF + WIDTH]
                if again.any():
                    for j in range(WIDTH):
                        hit = np.flatnonzero(again[j : j + count * STRIDE : STRIDE])
                        z[hit] += for_echo[j]
                pooled[a:b] = z.reshape(b - a, steps, FILTERS).max(1)
            pooled = np.maximum(pooled + self.shift, 0)
            chunks, first = chunk_starts(halves)
            value = np.maximum(pooled[chunks], pooled[chunks + 1])
            v = np.hstack([np.maximum.reduceat(value, first), np.add.reduceat(value, first) / (halves - 1)[:, None]])
            return 1 / (1 + np.exp(-np.clip(v @ self.weights + self.bias, -30, 30)))

        return score


def fit(texts: list[str], y: np.ndarray, rate: float = 0.86, epochs: int = 10, seed: int = 7) -> Model:
    """Backpropagation with Adam; gradients reach filters at the pooled positions only.

    The sample is balanced; ``rate`` is the prior that shifts the bias, so that
    scores read as probabilities among all documents.
    """
    rng = np.random.default_rng(seed)
    filters = rng.normal(0, 0.3, (WIDTH * CHANNELS, FILTERS))
    table = class_table().astype(np.float64)
    p = {"e": table + rng.normal(0, 0.05, table.shape) * (np.arange(256) > 0)[:, None], "f": filters, "s": np.zeros(FILTERS), "w": rng.normal(0, 0.2, 2 * FILTERS), "b": np.zeros(1)}
    if len(set(y.tolist())) < 2:
        return Model(table, np.zeros((WIDTH, CHANNELS, FILTERS)), p["s"], np.zeros(2 * FILTERS), 30.0 if not len(y) or y[0] else -30.0)
    mom = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    steps, t = HALF // STRIDE, 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            data, halves = laid([texts[i] for i in pick])
            x = np.hstack([p["e"].astype(np.float32)[data], echo(data)[:, None].astype(np.float32)])
            count = int(halves.sum()) * steps
            view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, 0)[: count * STRIDE : STRIDE].transpose(0, 2, 1)
            flat = view.reshape(count, -1)
            z = (flat @ p["f"].astype(np.float32)).reshape(-1, steps, FILTERS)
            arg = z.argmax(1)
            peak = np.take_along_axis(z, arg[:, None, :], 1)[:, 0] + p["s"]
            where = arg + np.arange(len(arg))[:, None] * steps
            act = np.maximum(peak, 0)
            chunks, first = chunk_starts(halves)
            later = act[chunks + 1] > act[chunks]
            value = np.where(later, act[chunks + 1], act[chunks])
            source = np.where(later, chunks[:, None] + 1, chunks[:, None])
            n_chunks = halves - 1
            top = np.maximum.reduceat(value, first)
            mean = np.add.reduceat(value, first) / n_chunks[:, None]
            v = np.hstack([top, mean])
            err = (1 / (1 + np.exp(-np.clip(v @ p["w"] + p["b"], -30, 30))) - y[pick]) / len(pick)
            g = {"w": v.T @ err + 1e-4 * p["w"], "b": err.sum(keepdims=True)}
            d_top, d_mean = err[:, None] * p["w"][:FILTERS], err[:, None] * p["w"][FILTERS:] / n_chunks[:, None]
            doc = np.repeat(np.arange(len(pick)), n_chunks)
            is_top = value == top[doc]
            share = np.add.reduceat(is_top, first)
            d_value = d_mean[doc] + is_top * d_top[doc] / share[doc]
            d_half = np.zeros_like(act)
            cols = np.broadcast_to(np.arange(FILTERS), source.shape)
            np.add.at(d_half, (source, cols), d_value)
            d_half *= act > 0
            g["s"] = d_half.sum(0)
            g["f"] = np.stack([d_half[:, k] @ flat[where[:, k]] for k in range(FILTERS)], 1)
            # A byte under a pooled filter moves by the filter's weights at its place; equal bytes are added up first.
            g["e"], by_place = 1e-4 * (p["e"] - table), p["f"].reshape(WIDTH, CHANNELS, FILTERS)
            for k in range(FILTERS):
                for j in range(WIDTH):
                    moved = np.bincount(data[where[:, k] * STRIDE + j], d_half[:, k], 256)
                    g["e"] += moved[:, None] * by_place[j, :-1, k]
            g["e"][0] = 0  # the padding stays
            t += 1
            for k in p:
                m, s = mom[k]
                m[:] = 0.9 * m + 0.1 * g[k]
                s[:] = 0.999 * s + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    prior = np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))
    return Model(p["e"], p["f"].reshape(WIDTH, CHANNELS, FILTERS), p["s"], p["w"], float(p["b"][0] + prior))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the bounded sample that ``labelled_sample`` describes; the prior is the labels' own rate."""
    texts, y = labelled_sample(documents, labels, label, PER_CLASS, MAX_CHARS)
    rate = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(label)).first()[0]
    return fit(texts, y, min(0.99, max(0.01, 0.5 if rate is None else rate)))


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append ``score`` and ``predicted``; columns of these names are replaced."""

    def make():
        scorer = model.scorer()
        return lambda texts: [scorer(texts).astype(float).tolist()]

    out = with_arrow(without(documents, ["predicted"]), text, [("score", T.DoubleType(), pa.float64())], make)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(documents, labels)
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
