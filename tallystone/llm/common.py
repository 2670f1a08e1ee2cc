"""What the training-data operators share: saved tables, hidden label folds, Arrow passes over texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once inside a Python task.
SLICE_BYTES = 2 << 20
#: Parts that the rows of a key are spread over where any share of all rows may hold it.
SALTS = 16
FREQUENT, FREQUENT_VALUES = 1000, 10_000
#: Bitmaps of row numbers, 4 KB each, that are sent to every executor at most.
BITMAPS = 8192
#: Paths of the tables saved in each open ``passing``.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint directory.

    A cluster names it in spark.checkpoint.dir. Where nothing is set and the
    master is a local one (tests on one machine), a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tallystone-")
        sc.setCheckpointDir(named)
    return str(sc.getCheckpointDir())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that no DataFrame in use reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are removed at the end, but those that outlive it."""
    outer, paths = _PASSING.get(), []
    _PASSING.set((*outer, paths))
    try:
        yield
    finally:
        _PASSING.set(outer)
        for path in paths:
            discard(spark, path)


def saved(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage; it may outlive the innermost ``passing``."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    frames = _PASSING.get()[: -1 if outlives else None]
    if frames:
        frames[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that clash with ``names``, ignoring case: results win over inputs."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def salted_join(rows: DataFrame, keyed: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join of ``keyed``, one row a value of ``on``, to rows of which any share may hold one value.

    Rows of the frequent values are spread by ``by`` and their partners repeated
    SALTS times. A value is frequent if it has more than FREQUENT rows; where more
    than FREQUENT_VALUES have, those with more than the FREQUENT_VALUES-th part of all
    rows are, so at most so many are broadcast. Where none is, the join is a plain one.
    """
    salt, hot, n = fresh(rows, "__salt"), fresh(rows, "__hot"), fresh(rows, "__n")
    frequent = saved(rows.groupBy(on).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > FREQUENT), "frequent-values")
    found = frequent.count()
    if not found:
        return rows.join(keyed, on)
    if found > FREQUENT_VALUES:
        frequent = frequent.where(F.col(n) > rows.count() // FREQUENT_VALUES)
    frequent = F.broadcast(frequent.select(on, F.lit(True).alias(hot)))
    spread = F.when(F.col(hot), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    copies = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(frequent, on, "left").withColumn(salt, spread).drop(hot)
    right = keyed.join(frequent, on, "left").withColumn(salt, F.explode(copies)).drop(hot)
    return left.join(right, [on, salt]).drop(salt)


def only_rows(df: DataFrame, picked: DataFrame, row: str) -> DataFrame:
    """The rows of ``df`` whose number, a long not below 0, is among ``picked``'s; ``df`` is not shuffled.

    The numbers travel as bitmaps, one for 32,768 of them. Where there are more
    than BITMAPS of these, none is sent about and the join is a shuffled one.
    """
    bucket, bits, place = fresh(df, "__bucket"), fresh(df, "__bits"), F.bitmap_bit_position(row)
    maps = saved(picked.groupBy(F.bitmap_bucket_number(row).alias(bucket)).agg(F.bitmap_construct_agg(place).alias(bits)), "row-bitmaps")
    if maps.count() > BITMAPS:
        return df.join(picked.select(row), row, "left_semi")
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = df.withColumn(bucket, F.bitmap_bucket_number(row)).join(F.broadcast(maps), bucket)
    return both.where(F.bit_get(byte, (place % 8).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or longer where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) in runs of bounded bytes; null becomes the empty text."""
    at, size, run = 0, 0, []
    for i, text in enumerate(texts):
        value = text.as_py() or ""
        if run and size + len(value) > limit:
            yield at, run
            at, size, run = i, 0, []
        run.append(value)
        size += len(value)
    if run:
        yield at, run


def with_arrow(df: DataFrame, text: str, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable[[], Callable[[list[str]], list[list]]]) -> DataFrame:
    """Append columns that a Python function makes of whole texts; no shuffle.

    ``make`` runs once a task and returns a function from a list of texts to
    one list per new column; texts come in slices of bounded bytes, and a slice's
    results leave before the next one's are made. Columns of the same names are
    replaced.
    """
    base = without(df, [n for n, _, _ in fields])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches):
        made = make()
        for batch in batches:
            for at, texts in slices(batch.column(text)):
                new = [pa.array(p, kind) for p, (_, _, kind) in zip(made(texts), fields, strict=True)]
                columns = [*batch.slice(at, len(texts)).columns, *new]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[n for n, _, _ in fields]])
        pa.default_memory_pool().release_unused()  # workers are kept for later stages

    return base.mapInArrow(run, schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, doc_id: str = "doc_id", text: str = "text"):
    """(texts, labels) for fitting, on the driver: at most ``per_class`` rows of either label.

    Only rows outside the held-out fold, picked by the smallest hash of the id,
    so the choice does not depend on partitions. Texts over ``max_chars`` are
    not learnt from (they are scored whole), which bounds the driver's memory
    at 2 * per_class * max_chars. Null labels, ids and texts are left out. A
    label of either kind beyond the bound only drops training rows.
    """
    key = F.xxhash64(F.col(doc_id).cast("string"))
    tagged = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    tagged = tagged.groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    size = documents.where(F.length(text) <= max_chars).select(F.col(doc_id))
    ids = tagged.join(size, doc_id, "left_semi")
    picked = None
    for y in (0, 1):
        top = ids.where(F.col("y") == y).orderBy(key, doc_id).limit(per_class)
        picked = top if picked is None else picked.unionByName(top)
    picked = picked.select(F.col(doc_id).alias("picked_id"), "y")
    rows = (
        documents.where(F.length(text) <= max_chars)
        .join(F.broadcast(picked), F.col(doc_id) == F.col("picked_id"))  # 2 * per_class rows at most
        .select(F.col(doc_id).alias("i"), F.col(text).alias("t"), "y")
    )
    # A repeated doc_id has one training row, so the driver's copy keeps its bound.
    rows = rows.groupBy("i").agg(F.min(F.struct("t", "y")).alias("r")).select("i", "r.t", "r.y")
    got = rows.toPandas().sort_values("i", key=lambda s: s.astype(str), kind="stable")
    return got["t"].tolist(), got["y"].to_numpy(dtype="int8")


def uri(path: str) -> str:
    """A path of the shared folder as Arrow's file systems take it."""
    head, colon, rest = path.partition(":")
    if not colon:
        return f"file://{path}"
    return path if rest.startswith("//") else f"{head}://{rest}"
