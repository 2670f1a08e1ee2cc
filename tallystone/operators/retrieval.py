"""Chunks, vectors and ranked retrieval."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.session import shared_path
from tallystone.sources.folders import files_below, opened

BLOCK, PART = 1024, 1 << 15
#: Characters of texts whose pieces a task holds at a time.
CHUNK_CHARS = 2_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one of them is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of all vectors for each query, exactly.

    Queries are written once to the shared folder, in files of about BLOCK. Vectors
    stay where they are: every task takes up to PART of its own at a time, reads the
    files one after another, multiplies two matrices and keeps k for each query;
    those few are merged by query. No vector is copied or shuffled, and a task holds
    one part and one block. Equal scores rank by id; ids and vectors without a null.
    """
    spark = vectors.sparkSession
    path = shared_path(spark, "query-blocks")
    asked = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("q"), F.col("embedding").cast("array<double>").alias("e"))
    asked.write.option("maxRecordsPerFile", BLOCK).parquet(path)
    blocks = [f.path for f in files_below(path, (".parquet",))]
    before = opened(path)[2]

    def unit(column: pa.Array) -> np.ndarray:
        lengths = np.diff(column.offsets.to_numpy())
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), lengths[0] if len(lengths) else 0)
        return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)

    def best(ids: np.ndarray, units: np.ndarray):
        for path in blocks:
            with opened(before + path)[0].open_input_file(path) as f:
                block = pq.read_table(f)
            if block.num_rows == 0 or len(ids) == 0:
                continue
            score = np.round(unit(block["e"].combine_chunks()) @ units.T, digits) + 0.0
            asking = block["q"].to_numpy()
            n = min(k, len(ids))
            # Candidates reach the k-th best score; ties at it are all kept until they are sorted by id.
            limit = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
            row, column = np.nonzero(score >= limit[:, None])
            value = score[row, column]
            order = np.lexsort((ids[column], -value, row))
            row, column, value = row[order], column[order], value[order]
            start = np.searchsorted(row, np.arange(len(asking)))
            kept = np.arange(len(row)) - start[row] < n
            yield pa.RecordBatch.from_arrays([pa.array(asking[row[kept]]), pa.array(ids[column[kept]]), pa.array(value[kept])], ["query_id", "vec_id", "score"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PART:
                yield from joined(held)
                held, size = [], 0
        yield from joined(held)

    def joined(held):
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield from best(table["vec_id"].to_numpy(), unit(table["embedding"].combine_chunks()))

    known = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    found = known.mapInArrow(run, "query_id long, vec_id long, score double")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def fixed_chunks(documents: DataFrame, source: Column, text: str, size: int = 800, overlap: float = 0.15, least: int = 50) -> DataFrame:
    """Chunks of ``size`` characters with overlap; pieces under ``least`` characters go."""
    from tallystone.functions.text import chunk_id

    step = size - int(size * overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    rows = documents.withColumn("__source", source).select("*", F.posexplode(starts).alias("chunk_index", "__start"))
    rows = rows.withColumn("chunk", F.substring(F.col(text), F.col("__start") + 1, F.lit(size))).where(F.length("chunk") >= least)
    return rows.withColumn("chunk_id", chunk_id(F.col("__source"), F.col("chunk_index"))).drop("__source", "__start")


LEVELS = (r"(?=\n第[一二三四五六七八九十]{1,3}章)", r"(?=\n#{1,3} )", r"\n\n", r"\n", r"(?<=[。！？.!?])\s*")


def split_text(text: str, size: int, level: int = 0) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest delimiter that serves."""
    if len(text) <= size:
        return [text] if text.strip() else []
    if level == len(LEVELS):
        return [text[i : i + size] for i in range(0, len(text), size)]
    out: list[str] = []
    for part in re.split(LEVELS[level], text):
        for piece in split_text(part, size, level + 1):
            if out and len(out[-1]) + len(piece) + 1 <= size:
                out[-1] += "\n" + piece
            else:
                out.append(piece)
    return out


def recursive_chunks(documents: DataFrame, key: str, text: str, size: int = 800, least: int = 50) -> DataFrame:
    """(key, chunk_index, chunk) by recursive splitting, batch-wise in Python as no expression recurses."""

    def run(batches):
        for df in batches:
            rows, held = [], 0
            for k, t in zip(df[key], df[text], strict=True):
                if held + len(t or "") > CHUNK_CHARS and rows:
                    yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])
                    rows, held = [], 0
                held += len(t or "")
                rows.extend((k, i, c) for i, c in enumerate(c for c in split_text(t or "", size) if len(c) >= least))
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, chunk string")


DIGITS = "一二三四五六七八九"


def chapter_numbers(most: int = 99) -> list[str]:
    """一 to 九十九 as chapters are numbered."""
    tens = lambda n: ("" if n == 1 else DIGITS[n - 1]) + "十" if n else ""
    return [tens(n // 10) + (DIGITS[n % 10 - 1] if n % 10 else "") for n in range(1, most + 1)]


#: Delimiters from coarse to fine by strategy; a piece begins with the delimiter that opens it.
STRATEGIES = {
    "chinese_regulation": [[f"\n第{n}章" for n in chapter_numbers()], ["\n\n"], ["\n"]],
    "generic": [["\n# "], ["\n## "], ["\n### "], ["\n\n"], ["\n"]],
}


def cores(text: str, size: int, least: int, levels: list[list[str]]) -> list[str]:
    """Pieces of at most ``size`` characters that make up the text, cut at the coarsest delimiters that serve.

    Neighbours that fit together stay together; what no delimiter cuts is cut by
    length. A piece shorter than ``least`` joins its neighbour where both fit.
    """
    if len(text) <= size:
        return [text] if text else []
    if not levels:
        return [text[i : i + size] for i in range(0, len(text), size)]
    pattern = "|".join(re.escape(d) for d in sorted(levels[0], key=len, reverse=True))
    cuts = [0, *[m.start() for m in re.finditer(pattern, text) if m.start()], len(text)]
    out: list[str] = []
    for a, b in zip(cuts, cuts[1:]):
        for piece in cores(text[a:b], size, least, levels[1:]):
            if out and len(out[-1]) + len(piece) <= size and (len(piece) < least or len(out[-1]) < least or b - a <= size):
                out[-1] += piece
            else:
                out.append(piece)
    return out


def chunks(documents: DataFrame, key: str, text: str, strategy: str = "chinese_regulation", size: int = 800, overlap: float = 0.15, least: int = 50) -> DataFrame:
    """(key, chunk_index, core, overlap, start): a text's pieces, and with each what follows it.

    The cores of a text, put together in their order, are the text, so its
    re-assembly is exact; ``overlap`` is the beginning of the next piece, ``size *
    overlap`` characters at most. A chunk to be embedded is core and overlap;
    ``worth_keeping`` tells those of ``least`` characters or more. Null texts have none.
    A task holds the pieces of ``CHUNK_CHARS`` characters at a time, or of one text.
    """
    levels, context = STRATEGIES[strategy], int(size * overlap)

    def run(batches):
        for whole in batches:
            rows, held = [], 0
            for k, t in zip(whole.column(0), whole.column(1)):
                k, t = k.as_py(), t.as_py() or ""
                if rows and held + len(t) > CHUNK_CHARS:
                    yield made(rows, whole.schema.field(0).type)
                    rows, held = [], 0
                held += len(t)
                pieces, start = cores(t, size, least, levels), 0
                for i, piece in enumerate(pieces):
                    rows.append((k, i, piece, pieces[i + 1][:context] if i + 1 < len(pieces) else "", start))
                    start += len(piece)
            if rows:
                yield made(rows, whole.schema.field(0).type)

    def made(rows, key_type):
        columns = zip(list(zip(*rows)), [key_type, pa.int32(), pa.string(), pa.string(), pa.int32()])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [key, "chunk_index", "core", "overlap", "start"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, chunk_index int, core string, overlap string, start int")


def worth_keeping(core: Column, overlap: Column, least: int = 50) -> Column:
    return F.length(core) + F.length(overlap) >= least


def reassembled(pieces: DataFrame, key: str, order: str = "chunk_index", core: str = "core") -> DataFrame:
    """(key, text) of texts put together from their cores."""
    return pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, core))), lambda c: c[core]), "").alias("text"))
