"""A data source of documents: text of md, txt and docx files below a folder, one row a file.

``spark.read.format("documents").load(folder)``, registered as ``read_documents`` does. Files
are dealt into partitions of about ``partition_bytes``, in order of their paths; a
larger file is a partition of its own. Filters on the extension, the path and the
length are applied to the list of files, so that files they drop are never opened
(``spark.sql.python.filterPushdown.enabled`` has to be true for that; Spark
applies them otherwise). A file that can't be read, has no text or has no reader
here (doc, pdf) is one row with its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from tallystone.sources.folders import Found, content, files_below, opened

#: Extensions that a library of documents takes.
EXTENSIONS = ("md", "txt", "docx", "doc", "pdf")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, extension string, length long, text string, error string"
ARROW = pa.schema([("path", pa.string()), ("extension", pa.string()), ("length", pa.int64()), ("text", pa.string()), ("error", pa.string())])
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


class NoText(ValueError):
    """A file without text, or without a reader."""


def plain_text(raw: bytes) -> str:
    """UTF-8 with whatever is no UTF-8 left out, and lines that end in a line feed."""
    return raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def _paragraphs(node: ElementTree.Element) -> Iterator[str]:
    """Text of paragraphs in their order, also inside content controls; those of tables are left out."""
    for child in node:
        if child.tag == f"{WORD}p":
            yield _line(child)
        elif child.tag in (f"{WORD}sdt", f"{WORD}sdtContent", f"{WORD}ins", f"{WORD}smartTag"):
            yield from _paragraphs(child)


def _line(paragraph: ElementTree.Element) -> str:
    parts = []
    for run in paragraph.iter():
        if run.tag == f"{WORD}t":
            parts.append(run.text or "")
        elif run.tag in (f"{WORD}br", f"{WORD}cr"):
            parts.append("\n")
        elif run.tag == f"{WORD}tab" and run.get(f"{WORD}val") is None:
            parts.append("\t")
    return "".join(parts)


def word_text(raw: bytes) -> str:
    """Paragraphs of a Word file that are not blank; where there is none, the text of its boxes, shapes and tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{WORD}body")
    if body is None:
        return ""
    boxed = {id(t) for box in body.iter(f"{WORD}txbxContent") for t in box.iter(f"{WORD}t")}
    for t in body.iter(f"{WORD}t"):
        if id(t) in boxed:
            t.text, t.tail = "", t.text
    lines = [line for line in _paragraphs(body) if line.strip()]
    return "\n".join(lines) if lines else "\n".join(x for t in body.iter(f"{WORD}t") if (x := (t.text or t.tail or "").strip()))


def text_of(path: str, raw: bytes) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("md", "txt", "docx"):
        raise NoText(f"no reader for {kind} files")
    text = word_text(raw) if kind == "docx" else plain_text(raw)
    if not text.strip():
        raise NoText("no text in the file")
    return text


@dataclass
class Files(InputPartition):
    files: list[Found]


def packed(files: list[Found], limit: int) -> list[list[Found]]:
    """Files in their order in runs of at most ``limit`` bytes; a larger file is a run of its own. A file counts 4 KB at least."""
    runs: list[list[Found]] = []
    size = 0
    for f in files:
        n = max(f.size, 4096)
        if not runs or size + n > limit:
            runs.append([])
            size = 0
        runs[-1].append(f)
        size += n
    return runs


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        wanted = options.get("extensions")
        self.suffixes = tuple(f".{e.strip().lower()}" for e in (wanted.split(",") if wanted else EXTENSIONS))
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            name = known.get(type(f))
            if name and f.attribute in (("path",), ("extension",), ("length",)):
                self.tests.append((name, f.attribute[0], f.value))
            else:
                yield f

    def _passes(self, f: Found, shown: str) -> bool:
        values = {"path": shown, "extension": _extension(f.path), "length": f.size}
        compare = {
            "eq": lambda a, b: a == b, "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b), "ends": lambda a, b: a.endswith(b), "has": lambda a, b: b in a,
            "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
        }
        return all(compare[op](values[column], value) for op, column, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        before = opened(self.root)[2]
        kept = [Found(before + f.path, f.size) for f in files_below(self.root, self.suffixes) if self._passes(f, before + f.path)]
        return [Files(run) for run in packed(kept, self.limit)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for f in partition.files:
            text, error = None, None
            try:
                text = text_of(f.path, content(f.path))
            except (OSError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
            rows.append((f.path, _extension(f.path), f.size, text, error))
            size += len(text or "")
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class Documents(DataSource):
    """Options: path (by load), extensions (comma-separated), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read_documents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, extension, length, text, error) of the documents below a folder."""
    spark.dataSource.register(Documents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("documents").options(**options).load(path)


def ingest_summary(documents: DataFrame) -> DataFrame:
    """One row: files, files with text, files with an error, characters."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return documents.agg(F.count(F.lit(1)).alias("n_files"), n(F.col("error").isNull()).alias("n_read"), n(F.col("error").isNotNull()).alias("n_errors"), n(F.length("text")).alias("n_chars"))


RESULT = "struct<result_id: string, check_type: string, rule_name: string, severity: string, passed: boolean, description: string, expected: string, actual: string, difference: string, confidence: double, source_file: string, page: string, context: string>"


def load_results(texts: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(results, problems) of result files held as texts: one row a result, and (path, problem) of files that hold none.

    A missing or odd ``meta`` is an empty map, missing or odd ``results`` are
    none; a field of another kind than expected is null. Files that are no JSON
    or no object are problems.
    """
    body = F.trim(F.col(text))
    parsed = texts.select(F.col(path), body.alias("__body"), F.try_parse_json(body).alias("__v"))
    kind = F.coalesce(F.schema_of_variant("__v"), F.lit(""))
    problem = F.when(F.col("__v").isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object")
    known = parsed.withColumn("problem", problem)
    field = lambda name, to: F.try_variant_get("__v", f"$.{name}", to)
    listed = F.try_variant_get("__v", "$.results", "array<variant>")
    rows = known.where("problem is null").select(path, F.coalesce(field("meta", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("meta"), F.explode(F.coalesce(listed, F.array().cast(listed_type()))).alias("__r"))
    names = [x.strip().split(": ") for x in RESULT[len("struct<") : -1].split(",")]
    return rows.select(path, "meta", *[F.try_variant_get("__r", f"$.{n}", t).alias(n) for n, t in names]), known.where("problem is not null").select(path, "problem")


def listed_type() -> str:
    return "array<variant>"
