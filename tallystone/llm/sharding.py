"""Sharding by a hypergeometric communication matrix.

The number of rows that each partition sends to each shard is drawn from the
multivariate hypergeometric distribution, given the partitions' sizes and exact
shard sizes, which differ by one at most; draws are exact at any size. Each
partition permutes its rows in the task that reads them, without an exchange, and
deals them out by its line of the matrix; rows are exchanged; every shard permutes
what it got. The result is a uniform shuffle with exact shard sizes (law ``rows``).

The driver holds one integer for each pair of partition and shard, as it holds
the partitions themselves; rows never pass it. The second permutation is cut
into blocks by the leading bits of its random key, so that a shard of any size
is ordered in tasks of about BLOCK_ROWS rows.

Defined cases: null and empty texts have size 8 and CRC 0; repeated rows are
rows of their own and are dealt apart; an empty table gives no rows; shards that
get no row are absent; columns named as results are replaced, others are kept
whatever their names; very long texts are rows as any.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import saved, without

SHARDS, SEED, BLOCK_ROWS = 24, 20240229, 50_000
#: Populations that the generator draws from by itself, and draws made row by row beyond them.
GENERATOR_RANGE, SINGLE = 1_000_000_000, 1000


def matrix(sizes: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows from each partition to each shard: partitions' sizes by line, equal shard sizes by column."""
    total = sum(sizes)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng, out = np.random.default_rng(seed), np.zeros((len(sizes), shards), np.int64)
    for i, n in enumerate(sizes):
        rest = int(left.sum())
        # Shard after shard: each takes a hypergeometric share of what the partition still has.
        need = int(n)
        for s in range(shards):
            if need == 0:
                break
            rest -= int(left[s])
            take = need if rest == 0 else _draw(rng, int(left[s]), rest, need)
            out[i, s], need = take, need - take
        left -= out[i]
    return out


def _draw(rng, good: int, bad: int, n: int) -> int:
    """An exact hypergeometric draw: how many of ``n`` rows taken from good and bad ones are good."""
    total = good + bad
    if total < GENERATOR_RANGE:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > total:
        return good - _draw(rng, good, bad, total - n)
    if n <= SINGLE:
        got = 0
        for i in range(n):
            got += int(rng.integers(total - i)) < good - got
        return got
    # Take each row with chance n / total. Whatever number comes, it is a uniform set of
    # that size, so taking the missing ones from the rest, or the excess from it, makes a uniform n-set.
    a, b = int(rng.binomial(good, n / total)), int(rng.binomial(bad, n / total))
    missing = n - a - b
    return a + _draw(rng, good - a, bad - b, missing) if missing >= 0 else a - _draw(rng, a, b, -missing)


def shard(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Append ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Columns of these names are replaced. The input is written once to the
    shared folder, which fixes its partitions and their permutations.
    """
    spark = rows.sparkSession
    base = without(rows, ["shard", "slot"])
    # The input's columns travel as one, so that their names meet no other.
    base = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("key"))
    number = F.monotonically_increasing_id()  # the partition, then 33 bits of the place in it
    base = base.sortWithinPartitions("key").select("row", number.alias("n"))
    base = base.select("row", F.shiftright("n", 33).cast("int").alias("part"), (F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("at"))
    base = saved(base, "shard-rows")
    sizes = {r[0]: r[1] for r in base.groupBy("part").count().collect()}
    parts = sorted(sizes)
    lines = matrix([sizes[p] for p in parts], shards, seed)
    ends = spark.createDataFrame([(p, np.cumsum(line).tolist()) for p, line in zip(parts, lines, strict=True)], "part int, ends array<long>")

    dealt = base.join(ends, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))).cast("int"))
    total = sum(sizes.values())
    bits = max(0, int(np.ceil(np.log2(max(1, total / shards / BLOCK_ROWS)))))
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(seed + 1), "part", "at"))
    dealt = dealt.withColumn("block", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    dealt = saved(dealt.drop("ends"), "shard-dealt")  # the exchange's input, read twice below

    counts = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Unsigned order of the key: the block, then the remaining bits.
    again = Window.partitionBy("shard", "block").orderBy(F.shiftleft("key", bits), "part", "at")
    placed = dealt.withColumn("rank", F.row_number().over(again)).join(offsets, ["shard", "block"])
    return placed.select("row.*", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns: every document in one of 24 shards."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
