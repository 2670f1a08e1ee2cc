"""One document of every group of near copies: SimHash by Golay keys, widened by bands of minima, verified exactly.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more (lower case, as the fingerprints; fewer words are one
shingle). Fingerprints four bits apart reach similarities of about 0.95; for what
lies below, BANDS bands of ROWS minima of the shingles' hashes give further keys, of
which a pair at 0.8 shares one with a chance of 0.996. Candidates, from either kind
of key, are compared by their sets of shingles; only those that hold link.

Texts with equal sets are one node. A task compares the nodes of a key by their
minima's low bytes, first one against all others; those surely alike leave, so a
dense group gives a few candidates a node, not all pairs. Verified first is each
node's best candidate; then the keys are looked through once more, by the nodes that
have candidates, for those that still lie between two groups.

Defined cases: texts without words, null ones too, are one group; repeated rows are
copies; the smallest id stays, rows without an id only where no other is in their
group; an empty table gives no rows; very long texts are compared whole; columns
stay whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm import simhash
from tallystone.llm.common import fresh, only_rows, passing, salted_join, saved, with_arrow
from tallystone.llm.components import roots

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 14, 5, 20240601
#: Agreement of minima from which nodes are candidates, and from which they leave a key's further comparisons.
MAYBE, SURELY = 0.68, 0.8
KEYS_A_TASK = 1 << 18


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; none for a text without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), ">u8").astype(np.uint64))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def minima(values: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of every hash function over a set."""
    a, b = functions
    least = np.full(len(a), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 2048):
            mixed = values[at : at + 2048, None] * a + b
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0))
    return least


def described(texts: list[str]) -> list[list]:
    """For every text: its set's digest, its 64-bit fingerprint, its bands' keys, and its minima's low bytes."""
    functions = _functions()
    node, fp, bands, low = [], [], [], []
    for text in texts:
        values = shingles(text)
        least = minima(values, functions)
        node.append(xxhash.xxh3_128_digest(values.tobytes()))
        fp.append(simhash.fingerprint(text))
        keys = [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) for i in range(0, len(least), ROWS)]
        bands.append([k - (1 << 64) if k >> 63 else k for k in keys])
        low.append((least & np.uint64(255)).astype(np.uint8).tobytes())
    return [node, fp, bands, low]


def _meeting(keys: np.ndarray, ids: np.ndarray, low: np.ndarray, root: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place, agreement) of nodes that share a key and may be alike; with roots, of those only that differ in theirs."""
    order = np.lexsort((ids * np.int64(0x5851F42D4C957F2D), keys))
    keys, low = keys[order], low[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(keys)])
    if root is not None and len(keys):
        root = root[order]
        mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        first, sizes = first[mixed], sizes[mixed]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alike = lambda x, y: ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)  # noqa: E731 - low bytes agree by chance, too
    apart = lambda x, y: True if root is None else root[x] != root[y]
    two = first[sizes == 2]
    share = alike(low[two], low[two + 1])
    near = (share >= MAYBE) & apart(two, two + 1)
    found.append((two[near], two[near] + 1, share[near]))
    for start, size in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        rest = np.arange(start, start + size)
        while len(rest) > 1:
            head, rest = rest[0], rest[1:]
            share = alike(low[rest], low[head])
            near = (share >= MAYBE) & apart(rest, head)
            found.append((np.full(int(near.sum()), head), rest[near], share[near]))
            rest = rest[share < SURELY]
    x, y, s = (np.concatenate(z) for z in zip(*found, strict=True))
    return order[x], order[y], s


def candidates_of(keys: np.ndarray, ids: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, agreement) of nodes that share a key and may be alike, ids a < b."""
    x, y, s = _meeting(keys, ids, low, None)
    return np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), s


def by_bands(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b, share) from nodes (id, bands, low)."""
    return _dealt(nodes, [])


def between(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b, share, root_a, root_b) of different roots, from nodes (id, bands, low, root).

    The candidates of ``by_bands`` that no group has within: a dense group that is
    one already gives none, however many nodes it has.
    """
    return _dealt(nodes, ["root"])


def _dealt(nodes: DataFrame, root: list[str]) -> DataFrame:
    spread = nodes.select("id", F.explode("bands").alias("key"), "low", *root)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * BANDS // KEYS_A_TASK)

    def run(batches):
        longs = {c: [np.zeros(0, np.int64)] for c in ("key", "id", *root)}
        low = [np.zeros((0, BANDS * ROWS), np.uint8)]
        for batch in batches:
            for c, parts in longs.items():
                parts.append(batch.column(c).to_numpy(zero_copy_only=False))
            low.append(np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS))
        made = {c: np.concatenate(parts) for c, parts in longs.items()}
        with np.errstate(over="ignore"):
            x, y, s = _meeting(made["key"], made["id"], np.concatenate(low), made.get("root"))
        swap = made["id"][x] > made["id"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        columns = {"a": made["id"][x], "b": made["id"][y], "share": s} | {f"root_{side}": made[c][z] for c in root for side, z in (("a", x), ("b", y))}
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))

    schema = "a long, b long, share double" + ", root_a long, root_b long" * bool(root)
    return spread.repartition(tasks, "key").mapInArrow(run, schema)


def by_fingerprints(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b, share) from nodes (id, fp): equal fingerprints, and those that Golay keys bring together."""
    least = saved(nodes.groupBy("fp").agg(F.min("id").alias("head")), "near-fingerprints")
    same = salted_join(nodes.select("fp", "id"), least, "fp", "id").where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b"))
    linked = saved(simhash.links(least.select("fp")).distinct(), "near-links")
    # A link's second end is its group's smallest fingerprint, which many links may have.
    a = linked.join(least.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
    a = salted_join(a, least.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b", "a")
    return same.unionByName(a.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).withColumn("share", F.lit(1.0))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, others) whose sets (id, set) are so similar; a set that many pairs have is spread."""
    with_b = salted_join(pairs, sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b", "a")
    both = salted_join(saved(with_b, "near-half"), sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a", "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common >= similarity * (F.size("set_a") + F.size("set_b") - common)).select(*pairs.columns)


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document, that of the smallest id, of every group of near copies; columns stay."""
    row, made = fresh(documents, "__row"), fresh(documents, "__made")
    kind = T.StructType().add("node", "binary").add("fp", "long").add("bands", T.ArrayType(T.LongType())).add("low", "binary")
    arrow = pa.struct([("node", pa.binary()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("low", pa.binary())])
    describe = lambda texts: [[dict(zip(("node", "fp", "bands", "low"), x, strict=True)) for x in zip(*described(texts), strict=True)]]
    marked = with_arrow(documents, text, [(made, kind, arrow)], lambda: describe).withColumn(row, F.monotonically_increasing_id())
    marked = saved(marked, "near-marked")
    with passing(documents.sparkSession):
        kept = saved(_representatives(marked, made, doc_id, text, row, similarity), "near-kept", outlives=True)
    return only_rows(marked, kept, row).select(*[F.col(f"`{c}`") for c in documents.columns])


def _representatives(marked: DataFrame, made: str, doc_id: str, text: str, row: str, similarity: float) -> DataFrame:
    """The row of the kept document of every group; texts are not shuffled, and tables no step reads any more are removed."""
    spark = marked.sparkSession
    rows = marked.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(row).alias("row"), f"{made}.*")

    # A node is named by the first row that has it; its best document is kept beside.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    nodes = saved(rows.groupBy("node").agg(F.min("row").alias("id"), best, F.min("fp").alias("fp"), F.min("low").alias("low"), F.min_by("bands", "row").alias("bands")).drop("node"), "near-nodes")
    with passing(spark):
        linked = saved(by_fingerprints(nodes).where("a <> b"), "near-linked", outlives=True)
        pairs = by_bands(nodes).where("a <> b").unionByName(linked)
        pairs = saved(pairs.groupBy("a", "b").agg(F.max("share").alias("share")), "near-pairs", outlives=True)

    # Sets of those nodes only that have a candidate, made from their texts.
    asked = pairs.select(F.col("a").alias(row)).unionByName(pairs.select(F.col("b").alias(row))).distinct()
    texts = only_rows(marked.select(row, F.col(f"`{text}`").alias("text")), asked, row)
    as_longs = lambda t: pa.array(shingles(t).view(np.int64), pa.int64())
    sets = with_arrow(texts, "text", [("set", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], lambda: lambda ts: [[as_longs(t) for t in ts]])
    sets = saved(sets.select(F.col(row).alias("id"), "set"), "near-sets")

    first = pairs.groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a")).select("a", "b")
    with passing(spark):
        held = saved(verified(first, sets, similarity), "near-held", outlives=True)
    with passing(spark):
        group = saved(roots(held), "near-groups", outlives=True)
    # Candidates that still lie between two groups: those within one are not made again, so a dense group gives none.
    inside = saved(sets.select("id").join(group, sets["id"] == group["node"], "left").select("id", F.coalesce("root", "id").alias("root")), "near-inside")
    apart = between(nodes.join(inside, "id").select("id", "bands", "low", "root")).where("a <> b").drop("share")
    for side, by in (("a", "b"), ("b", "a")):
        linked = salted_join(linked, inside.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}")), side, by)
    apart = apart.unionByName(linked.drop("share").where("root_a <> root_b")).distinct()
    apart = saved(apart.join(first, ["a", "b"], "left_anti"), "near-apart")
    with passing(spark):
        bridges = saved(verified(apart, sets, similarity).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "near-bridges", outlives=True)
    if bridges.limit(1).count():
        above = roots(bridges)
        group = group.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(above).groupBy("node").agg(F.min("root").alias("root"))

    named = nodes.select("id", "best").join(group, nodes["id"] == group["node"], "left").select("best", F.coalesce("root", "id").alias("root"))
    return named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
