"""Workbooks as bytes, one a group of rows: a sheet each, header rows in bold, texts kept as texts.

A workbook is made by the task that holds its rows, as one file has to be; any
number of workbooks are made side by side. Columns of numbers are written as
numbers, others as text; characters that XML can't hold are left out, sheet names
are cut to what a workbook takes, and equal ones get numbers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
BEYOND_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
LONGEST_CELL, LONGEST_NAME, MOST_ROWS = 32_767, 31, 1_048_576
#: Sheets of a report's workbook, in order, by the categories that ``display.sheet_category`` gives.
REPORT_SHEETS = ["报表内勾稽", "表注勾稽", "附注内勾稽", "横加竖加", "文本格式", "其他"]
SUMMARY_SHEET = "汇总"


def column_name(i: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    name = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        name = chr(65 + rest) + name
    return name


def sheet_names(wanted: Sequence[str]) -> list[str]:
    """Names that a workbook takes: 31 characters, none of []:*?/\\, no two alike."""
    out: list[str] = []
    for name in wanted:
        base = re.sub(r"[\[\]:*?/\\]", "_", BEYOND_XML.sub("", name)).strip("'")[:LONGEST_NAME] or "Sheet"
        made, k = base, 2
        while made.lower() in {o.lower() for o in out}:
            end = f"_{k}"
            made, k = base[: LONGEST_NAME - len(end)] + end, k + 1
        out.append(made)
    return out


def _cell(place: str, value: object, style: str) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}"{style} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f'<c r="{place}"{style}><v>{value!r}</v></c>'
    text = escape(BEYOND_XML.sub("", str(value))[:LONGEST_CELL])
    return f'<c r="{place}"{style} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _sheet(rows: Iterable[Sequence[object]]) -> str:
    lines = []
    for r, row in enumerate(rows):
        if r == MOST_ROWS:
            raise ValueError("a sheet holds 1,048,576 rows at most")
        style = ' s="1"' if r == 0 else ""
        lines.append(f'<row r="{r + 1}">' + "".join(_cell(f"{column_name(c)}{r + 1}", v, style) for c, v in enumerate(row)) + "</row>")
    return f'<worksheet xmlns="{MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{"".join(lines)}</sheetData></worksheet>'


def workbook(sheets: Sequence[tuple[str, Iterable[Sequence[object]]]]) -> bytes:
    """The file of a workbook; the first row of every sheet is its header. The same sheets give the same bytes."""
    names = sheet_names([n for n, _ in sheets]) or ["Sheet"]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
        + "".join(f'<Relationship Id="rId{i + 1}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        + f'<Relationship Id="rId{len(names) + 1}" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf xfId="0"/><xf xfId="0" fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    bodies = [rows for _, rows in sheets] or [[]]
    parts |= {f"xl/worksheets/sheet{i + 1}.xml": _sheet(rows) for i, rows in enumerate(bodies)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, sheet: Column, order: str, columns: list[str], sheets: list[str] | None = None) -> DataFrame:
    """(name, content): a workbook for each value of ``key``, a sheet for each category, rows in their order.

    ``sheets`` come first in that order, also where they have no rows; others
    follow by name. A first sheet sums up the rows of each.
    """
    kept = rows.select(F.col(key).cast("string").alias("__key"), F.coalesce(sheet, F.lit("")).alias("__sheet"), F.col(order).alias("__order"), *columns)
    first = list(sheets or [])

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__order"], kind="stable")
        groups = {name: g for name, g in pdf.groupby("__sheet", sort=True)}
        names = first + [n for n in groups if n not in first]
        plain = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v
        body = lambda g: [columns] + [[plain(v) for v in r] for r in g[columns].itertuples(index=False, name=None)]
        total = [[SUMMARY_SHEET, "n"]] + [[n, len(groups.get(n, ()))] for n in names]
        content = workbook([(SUMMARY_SHEET, total)] + [(n, body(groups[n]) if n in groups else [columns]) for n in names])
        key_value = pdf["__key"].iloc[0]
        return pd.DataFrame({"name": [f"{'' if key_value is None else key_value}.xlsx"], "content": [content]})

    return kept.groupBy("__key").applyInPandas(make, "name string, content binary")
