"""Tables inside Markdown and HTML texts, as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def markdown_tables(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, row_no, cells): runs of lines that begin with a pipe, separators left out."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = lines.where(F.trim("line").startswith("|"))
    over = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("__new", (F.col("line_no") - F.lag("line_no", 1, -2).over(over) > 1).cast("int"))
    rows = rows.withColumn("table_no", F.sum("__new").over(over) - 1).where(~F.col("line").rlike(r"^\s*\|[\s:|\-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select(key, "table_no", (F.row_number().over(Window.partitionBy(key, "table_no").orderBy("line_no")) - 1).alias("row_no"), cells.alias("cells"))


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, cells) of the tables of each page, markup dropped."""
    found = F.regexp_extract_all(html, F.lit("(?is)<table[^>]*>(.*?)</table>"), 1)
    rows = pages.select(key, F.posexplode(found).alias("table_no", "__t")).select(key, "table_no", F.posexplode(F.regexp_extract_all("__t", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "__r"))
    cells = F.transform(F.regexp_extract_all("__r", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    return rows.select(key, "table_no", "row_no", cells.alias("cells"))


#: Marks of the element that holds an article, tried in this order.
BODIES = ('class="pages_content"', 'class="trs_editor_view')


def balanced(html: Column, mark: Column | str, tag: str = "div") -> Column:
    """What the element with ``mark`` in its opening tag holds, up to the closing tag that balances it.

    Every opening tag of the kind goes one level down, a self-closed one too, and
    every closing tag one up; other tags and void ones don't count. Empty text where
    the mark is missing or its element is never closed; null for null. A fold over
    the pieces between tags, without a Python worker.
    """
    mark = F.lit(mark) if isinstance(mark, str) else mark
    at = F.position(mark, html)
    rest = F.substring(html, at, F.length(html))
    begin = F.position(F.lit(">"), rest)
    inside = F.when((at > 0) & (begin > 0), F.substring(rest, begin + 1, F.length(html)))
    pieces = F.split(inside, rf"(?i)(?=<{tag}(?![a-zA-Z0-9-]))|(?=</{tag}\s*>)")
    step = lambda piece: F.when(piece.rlike(rf"(?i)^<{tag}(?![a-zA-Z0-9-])"), 1).when(piece.rlike(rf"(?i)^</{tag}\s*>"), -1).otherwise(0)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def follow(state: Column, piece: Column) -> Column:
        depth = state["depth"] + step(piece)
        # Depth 0 is where the element ends; from there on nothing changes.
        return F.when(state["depth"] == 0, state).otherwise(F.struct(depth.alias("depth"), (state["n"] + (depth > 0).cast("int")).alias("n")))

    n = F.aggregate(pieces, start, follow, lambda state: F.when(state["depth"] == 0, state["n"]).otherwise(F.lit(-1)))
    body = F.get(F.transform(F.array(n), lambda k: F.when(k >= 0, F.array_join(F.slice(pieces, F.lit(1), k), "")).otherwise("")), F.lit(0))
    return F.when(html.isNotNull(), F.coalesce(body, F.lit("")))


def article_body(html: Column, marks: tuple[str, ...] = BODIES) -> Column:
    """The body of an article's page: the element of the first mark that stands in it."""
    found = F.when(F.contains(html, F.lit(marks[0])), balanced(html, marks[0]))
    for mark in marks[1:]:
        found = found.when(F.contains(html, F.lit(mark)), balanced(html, mark))
    return found.otherwise(F.when(html.isNotNull(), ""))


def main_content(html: Column) -> Column:
    """What a page is about: the element of class vp-doc, else article, else main, else body; empty where none is whole."""
    marked = F.regexp_extract(html, r'(?i)<div[^>]*class="[^"]*\bvp-doc\b[^"]*"', 0)
    options = [F.when(marked != "", balanced(html, marked))]
    for tag in ("article", "main", "body"):
        opening = F.regexp_extract(html, rf"(?i)<{tag}(?![a-zA-Z0-9-])[^>]*>", 0)
        options.append(F.when(opening != "", balanced(html, opening, tag)))
    return F.coalesce(*[F.when(o != "", o) for o in options], F.when(html.isNotNull(), F.lit("")))


def readable(html: Column) -> Column:
    """Text of markup: scripts and styles and comments left out, blocks on lines of their own, one blank line at most between."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|header)\b.*?</\1\s*>", "")
    heads = bare
    for n in range(1, 7):
        heads = F.regexp_replace(heads, rf"(?is)<h{n}[^>]*>\s*(.*?)\s*</h{n}>", "\n\n" + "#" * n + " $1\n\n")
    lines = F.regexp_replace(F.regexp_replace(heads, r"(?i)<li[^>]*>\s*", "\n- "), r"(?i)</?(p|div|tr|ul|ol|table|blockquote)\b[^>]*>|<br\s*/?>", "\n")
    text = F.regexp_replace(lines, "<[^>]+>", "")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    text = F.regexp_replace(text, r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
