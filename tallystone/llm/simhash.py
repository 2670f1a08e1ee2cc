"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. A segment is
taken as a 23-bit word of the perfect Golay code; its indices are those of all
codewords within four bits, one or six. Two words that differ in two bits at most
always share such an index, by the code's Steiner system. With four differing bits
at most, either every segment differs in two bits at most, and the three segments'
indices joined are a key of 36 bits; or one differs in more and the others in one
bit together (pigeonhole), so one of them is equal and its bits joined with the
other's index are a key of 33 or 34. A fingerprint has 180 keys on average, of
some 10^11, so buckets stay small up to some 10^10 distinct texts.

Distinct fingerprints meet by key, are verified exactly, and every task keeps
only a spanning forest of the links it found, so a dense group yields fewer
links than members. Large buckets are searched breadth-first: what is linked is
not compared again. Components of the links follow on DataFrames.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; fewer than four words are one shingle; equal fingerprints, so repeated
rows, share a component; a null id is no component's name unless it is alone; an
empty table gives no rows; very long texts are hashed whole; ``keep_one`` keeps
all columns whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import fresh, salted_join, saved, with_arrow
from tallystone.llm.components import roots

SHINGLE, SEED, NEAR = 4, 42, 4
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b110001110101  # of the binary Golay code of length 23
KEYS, KEYS_A_TASK = 180, 1 << 20
#: Buckets above this are searched breadth-first, smaller ones pair by pair.
LARGE = 64


def fingerprint(text: str) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 << 15):
        votes += np.unpackbits(np.frombuffer(hashes[at : at + (8 << 15)], np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def with_fingerprints(documents: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    return with_arrow(documents, text, [(name, T.LongType(), pa.int64())], lambda: lambda texts: [[fingerprint(t) for t in texts]])


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; for each syndrome the errors of weight four at most, six in a row (-1: none)."""
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        parity[m] = r
    near = np.array([sum(1 << i for i in c) for n in range(5) for c in combinations(range(23), n)])
    syndrome = parity[near >> 11] ^ (near & 2047)
    order = np.argsort(syndrome, kind="stable")
    syndrome, near = syndrome[order], near[order]
    place = np.arange(len(near)) - np.searchsorted(syndrome, syndrome)
    errors = np.full((2048, 6), -1, np.int64)
    errors[syndrome, place] = near
    return parity, errors


def fuzzy_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints."""
    parity, errors = tables
    parts, segments = [], []
    for low, bits in SEGMENTS:
        x = (fps.astype(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
        error = errors[parity[x >> 11] ^ (x & 2047)]
        segments.append(x)
        parts.append(np.where(error >= 0, (x[:, None] ^ error) >> 11, -1))
    rows, keys = [], []

    def add(kind: int, key: np.ndarray, some: np.ndarray) -> None:
        row, col = np.nonzero(some.reshape(len(fps), -1))
        rows.append(row)
        keys.append(key.reshape(len(fps), -1)[row, col] | kind << 36)

    a, b, c = parts[0][:, :, None, None], parts[1][:, None, :, None], parts[2][:, None, None, :]
    add(0, a << 24 | b << 12 | c, (a >= 0) & (b >= 0) & (c >= 0))
    for kind, (i, j) in enumerate(permutations(range(3), 2), 1):
        add(kind, segments[i][:, None] << 12 | parts[j], parts[j] >= 0)
    return np.concatenate(rows), np.concatenate(keys)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: (member, smallest member), members other than it."""
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints that share a key and differ in NEAR bits at most, as a forest."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    large = np.repeat(sizes > LARGE, sizes)
    small_keys, small_fps = keys[~large], fps[~large]
    for d in range(1, LARGE):
        at = np.flatnonzero(small_keys[d:] == small_keys[:-d])
        if not len(at):
            break
        at = at[_differ(small_fps[at], small_fps[at + d]) <= NEAR]
        a.append(small_fps[at])
        b.append(small_fps[at + d])
        if sum(map(len, a)) > 4 << 20:
            a, b = ([z] for z in forest(np.concatenate(a), np.concatenate(b)))
    for start, size in zip(first[sizes > LARGE].tolist(), sizes[sizes > LARGE].tolist(), strict=True):
        rest = fps[start : start + size]
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                hit = _differ(rest, front[0]) <= NEAR
                found, rest = rest[hit], rest[~hit]
                a.append(np.full(len(found), front[0]))
                b.append(found)
                front = np.concatenate([front[1:], found])
    return forest(np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints of column ``fp`` reach each other."""
    n = fps.count()
    tasks = max(1, n * KEYS // KEYS_A_TASK, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType().add("key", "long").add("fp", "long")

    def keyed(batches):
        tables = golay_tables()
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                row, key = fuzzy_keys(part, tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    def linked(batches):
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            values.append(batch.column("fp").to_numpy(zero_copy_only=False))
        a, b = bucket_links(np.concatenate(keys), np.concatenate(values))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    spread = fps.repartition(max(1, min(tasks, -(-n // 2000))), "fp")
    return spread.mapInArrow(keyed, schema).repartition(tasks, "key").mapInArrow(linked, T.StructType().add("a", "long").add("b", "long"))


def component_of(rows: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``rows`` (doc_id, fp)."""
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = roots(links(nodes.select("fp")))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return salted_join(rooted, names, "root", "fp").select("fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows = saved(with_fingerprints(documents.select("doc_id", "text")).select("doc_id", "fp"), "simhash-rows")
    out = salted_join(rows, component_of(rows), "fp", "doc_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document, that of the smallest id, of every group of linked ones; columns stay."""
    row, fp = fresh(documents, "__row"), fresh(documents, "__fp")
    marked = with_fingerprints(documents, text, fp).withColumn(row, F.monotonically_increasing_id())
    marked = saved(marked, "simhash-marked")
    rows = marked.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    named = component_of(rows)
    kept = best.join(named, "fp").groupBy("component_id").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])
