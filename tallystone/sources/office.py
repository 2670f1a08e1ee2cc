"""Rows of .docx and .xlsx files, read from their zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "path string, table_name string, row_no int, cells array<string>, error string"


def docx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(table, row, cells) of a document's innermost tables; a cell stands once for each column it spans."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    leaves = [t for t in root.iter(f"{WORD}tbl") if t.find(f".//{WORD}tbl") is None]
    for n, table in enumerate(leaves):
        for r, row in enumerate(table.iter(f"{WORD}tr")):
            cells: list[str] = []
            for cell in row.iter(f"{WORD}tc"):
                span = cell.find(f"{WORD}tcPr/{WORD}gridSpan")
                text = "".join(x.text or "" for x in cell.iter(f"{WORD}t"))
                cells += [text] * int(span.get(f"{WORD}val", 1) if span is not None else 1)
            yield f"table{n}", r, cells


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, values) of a workbook, shared strings resolved, gaps filled with empty cells."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    strings: list[str] = []
    if "xl/sharedStrings.xml" in names:
        strings = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
    # A sheet's file is named by its relation, not by its place among the sheets.
    related = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
        sheet, target = s.get("name"), related.get(s.get(RELATION), "")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part not in names:
            continue
        for r, row in enumerate(ElementTree.fromstring(book.read(part)).iter(f"{SHEET}row")):
            cells: list[str] = []
            for cell in row.iter(f"{SHEET}c"):
                column = 0
                for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [""] * max(0, column - 1 - len(cells))
                value = cell.find(f"{SHEET}v")
                raw = value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                cells.append(strings[int(raw)] if cell.get("t") == "s" and raw else raw or "")
            yield sheet, r, cells


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all .docx and .xlsx files below a path; a file that can't be read is one row with its error."""

    def run(batches):
        for df in batches:
            rows: list[tuple] = []
            for name, content in zip(df["path"], df["content"], strict=True):
                try:
                    reader = docx_rows if name.endswith(".docx") else xlsx_rows
                    rows += [(name, t, r, c, None) for t, r, c in reader(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "table_name", "row_no", "cells", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx}").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
