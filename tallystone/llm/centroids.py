"""Centroid clustering by sort-means, in whole numbers.

A vector's components become the integers floor(64 * x). In each round the other
centroids are ordered by their distance from every centroid; a vector looks at
them in the order that its previous centroid gives and stops at the first that
lies strictly beyond twice its distance to that centroid: by the triangle
inequality neither it nor any later one can be nearer or as near. Equal
distances go to the smaller number, so the result is that of looking at all.

A round is one pass without a shuffle: tasks write the vectors with their new
numbers and one line of sums a cluster; Spark adds the lines up exactly, and
the driver holds k centroids. Every round's table is written to the shared
folder, and the one before it is removed.

Defined cases: null vectors, vectors of another length and those with a null or
non-finite component have no row; a null vec_id is hashed as ``null`` and comes
after all others when centroids are picked; repeated ids are vectors of their own
(equal hashes are ordered by components); with fewer than k vectors each starts a
centroid; an empty table gives no rows; extra columns are left out, whatever
their names; components beyond +-2**27 count as +-2**27, so that every distance
fits a long; a sum of distances beyond the largest long is given as that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import discard, fresh_path

K, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64.0, 1
LIMIT, LARGEST = 1 << 27, (1 << 63) - 1
#: Below this size of components float64 holds every squared distance of 64 of them exactly.
EXACT = 1 << 22
BATCH = 8192
STATE = T.StructType().add("vec_id", "long").add("v", T.ArrayType(T.IntegerType())).add("cluster", "integer").add("distance", "long").add("total", T.ArrayType(T.LongType())).add("n", "long")
ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("total", pa.list_(pa.int64())), ("n", pa.int64()), ("part", pa.string())])


def usable(vector: Column, dimensions: int) -> Column:
    """True for vectors of the wanted length whose components are all finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def integers(vector: Column) -> Column:
    scaled = F.transform(vector, lambda x: F.lit(SCALE) * x.cast("double"))
    return F.transform(scaled, lambda x: F.floor(F.least(F.greatest(x, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.einsum("ij,ij->i", d, d)


def sort_means(points: np.ndarray, centres: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of every point, and how many distances were computed.

    ``before`` holds each point's previous centroid.
    """
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT:
        points, centres = points.astype(np.float64), centres.astype(np.float64)
    number, distance, computed = np.empty(len(points), np.int32), np.empty(len(points), np.int64), 0
    for a in np.unique(before).tolist():
        mine = np.flatnonzero(before == a)
        own = squared(points[mine], centres[a])
        # Farthest points first: those that still look on are always the first ones.
        order = np.argsort(-own, kind="stable")
        mine, own = mine[order], own[order]
        near, best, at = points[mine], own.copy(), np.full(len(mine), a, np.int32)
        gaps = squared(centres, centres[a])
        computed += len(mine)
        for j in np.argsort(gaps, kind="stable").tolist():
            if j == a:
                continue
            # sqrt(gap) > 2 * sqrt(own) ends the scan; equality does not.
            n = int(np.searchsorted(-4 * own, -gaps[j], side="right"))
            if n == 0:
                break
            d = squared(near[:n], centres[j])
            computed += n
            nearer = (d < best[:n]) | ((d == best[:n]) & (j < at[:n]))
            best[:n][nearer], at[:n][nearer] = d[nearer], j
        number[mine], distance[mine] = at, best
    return number, distance, computed


def _pass(state: DataFrame, centres: list[list[int]], path: str) -> None:
    """Assign every vector anew; rows and sums of clusters are written side by side under ``path``."""
    k, dims = len(centres), len(centres[0])

    def run(batches):
        fixed = np.array(centres, np.int64)
        totals, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                points = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
                number, distance, _ = sort_means(points, fixed, batch.column("cluster").to_numpy(zero_copy_only=False))
                for c in np.unique(number).tolist():
                    member = points[number == c]
                    totals[c] += member.sum(0)
                    counts[c] += len(member)
                none = pa.nulls(batch.num_rows)
                rows = [batch.column("vec_id"), batch.column("v"), pa.array(number), pa.array(distance), none.cast(ARROW.field("total").type), none.cast(pa.int64()), pa.array(["rows"] * batch.num_rows)]
                yield pa.RecordBatch.from_arrays(rows, schema=ARROW)
        full = np.flatnonzero(counts)
        if len(full):
            none = pa.nulls(len(full))
            sums = [none.cast(pa.int64()), none.cast(ARROW.field("v").type), pa.array(full.astype(np.int32)), none.cast(pa.int64()), pa.array(totals[full].tolist(), ARROW.field("total").type), pa.array(counts[full]), pa.array(["sums"] * len(full))]
            yield pa.RecordBatch.from_arrays(sums, schema=ARROW)

    made = state.select("vec_id", "v", "cluster").mapInArrow(run, T.StructType([*STATE.fields, T.StructField("part", T.StringType())]))
    made.write.partitionBy("part").option("compression", "zstd").parquet(path)


def _moved(sums: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: floor of the exact mean; those without vectors stay. k * dimensions rows reach the driver."""
    exact = T.DecimalType(38, 0)
    each = sums.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast(exact)).alias("t"), F.sum(F.col("n").cast(exact)).alias("n"))
    out = [list(c) for c in centres]
    for r in each.collect():
        out[r["cluster"]][r["pos"]] = int(r["t"]) // int(r["n"])
    return out


def digest(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster and distance of every usable vector; the centroids after the last round)."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    state = raw.where(usable(F.col("v"), dimensions)).select("vec_id", integers(F.col("v")).alias("v"), F.lit(0).alias("cluster"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    centres = [list(r[0]) for r in state.orderBy(F.col("vec_id").isNull(), key, "v").limit(k).select("v").collect()]
    if not centres:
        return state.select("vec_id", "v", "cluster", F.lit(0).cast("long").alias("distance")).limit(0), []
    last = None
    for step in range(rounds + 1):
        path = fresh_path(spark, "centroid-rows")
        _pass(state, centres, path)
        state = spark.read.schema(STATE).parquet(f"{path}/part=rows")
        if last:
            discard(spark, last)
        last = path
        if step < rounds:
            centres = _moved(spark.read.schema(STATE).parquet(f"{path}/part=sums"), centres)
    return state.select("vec_id", "v", "cluster", "distance"), centres


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns; what is broadcast is one row a centroid."""
    spark = embeddings.sparkSession
    rows, centres = cluster(embeddings)
    exact = T.DecimalType(38, 0)
    sums = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast(exact))).collect()}
    inertia = min(LARGEST, sum(sums.values()))
    facts = [(c, min(LARGEST, s), inertia, digest(centres[c])) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("v").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(n: int) -> str:
    """Every vector and its nearest centroid of round ``n``."""
    return f"""a{n} as (select vec_id, v, arg_min(c, d * 16 + c)::int as cluster, min(d) as distance from (
select k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept k cross join c{n} c) group by vec_id, v)"""


def _means(n: int) -> str:
    """The centroids after round ``n``: floor division, also below zero."""
    return f"""c{n + 1} as (select c.c, coalesce(m.v, c.v) as v from c{n} c left join (
select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from (
select cluster, i, sum(v[i])::bigint as s, count(*)::bigint as n from a{n} cross join range(1, 65) r(i) group by cluster, i) group by cluster) m on m.cluster = c.c)"""


def oracle() -> str:
    """DuckDB SQL that looks at every centroid for every vector; vec_ids are unique in the given tables."""
    steps = [x for n in range(ROUNDS) for x in (_assigned(n), _means(n))]
    return f"""with kept as (select vec_id, list_transform(embedding, lambda x: floor(64.0 * x::double)::bigint) as v from embeddings
where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select (row_number() over (order by h) - 1)::int as c, v from (select sha256('1:' || vec_id) as h, v from kept order by h limit 16)),
{", ".join(steps)}, {_assigned(ROUNDS)}
select a.vec_id, a.cluster, a.distance, sum(a.distance) over (partition by a.cluster)::bigint as cluster_inertia, sum(a.distance) over ()::bigint as inertia,
sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on c.c = a.cluster"""
