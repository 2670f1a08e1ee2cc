"""Which files are read and how, and what their parts belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of files with one name the format that is read, best first; formats by reader.
FORMATS = {"docx": 3, "pdf": 2, "doc": 1}
WORKBOOKS = ["xlsx", "xlsm", "xlsb"]
TEXTS = ["md", "txt", "docx", "doc", "pdf"]
#: Sheet names of a workbook of statements.
STATEMENT_SHEETS = ["资产负债表", "利润表", "现金流量表", "权益变动表", "股东权益"]
#: Words of files of statements and of notes, by which results find their source.
STATEMENT_FILES = ["财务报表", "资产负债表", "利润表", "现金流量表", "balance", "financial"]
NOTE_FILES = ["附注", "notes", "note", "annex"]
NOTE_CHECKS = ["表注", "附注内", "横加", "竖加"]
#: Chinese digits of chapters, the chapter whose items are numbered, and beginnings that are no item.
CHAPTER_DIGITS = "一二三四五六七八九十"
ITEM_CHAPTER = "五"
NO_ITEM = ["（", "(", "本公司", "注", "年末", "年初", "本年", "上述", "截止"]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]+$", ""))


def one_per_name(files: DataFrame, path: str) -> DataFrame:
    """Of the files with one name in a folder the best format, of equals the first path; other formats go."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), extension(F.col(path)))
    named = files.withColumn("__rank", rank).where("__rank is not null").withColumn("__stem", stem(F.col(path))).withColumn("__folder", F.regexp_extract(path, r"^(.*?)[^/\\]*$", 1))
    over = Window.partitionBy("__folder", "__stem").orderBy(F.desc("__rank"), path)
    return named.withColumn("__k", F.row_number().over(over)).where("__k = 1").drop("__rank", "__stem", "__folder", "__k")


def scanned_first_page(text: Column) -> Column:
    """A PDF whose first page has 50 characters at most."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) <= 50


def scanned_documents(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, scanned): a mean of less than 50 characters a page."""
    return pages.groupBy(key).agg((F.avg(F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))) < 50).alias("scanned"))


def of_images(n_shapes: Column, n_tables: Column) -> Column:
    """A Word file of pictures: three or more, or any without a table."""
    return (n_shapes >= 3) | ((n_tables == 0) & (n_shapes > 0))


def route(path: Column, first_page: Column, n_shapes: Column, n_tables: Column) -> Column:
    """How a file is read: ocr, pdf_text, docx_xml or skipped (old Word files and other formats)."""
    kind = extension(path)
    return F.when((kind == "pdf") & scanned_first_page(first_page), "ocr").when(kind == "pdf", "pdf_text").when((kind == "docx") & of_images(n_shapes, n_tables), "ocr").when(kind == "docx", "docx_xml").otherwise("skipped")


def workbook_role(path: Column, sheets: Column) -> Column:
    """statements or notes by the names of a workbook's sheets; null for other files."""
    hit = F.exists(sheets, lambda s: reduce(lambda a, b: a | b, [s.contains(w) for w in STATEMENT_SHEETS]))
    return F.when(extension(path).isin(WORKBOOKS), F.when(hit, "statements").otherwise("notes"))


def text_outside(chars: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """(page, line, text) of the characters whose centre is in no box of their page.

    Reads x0, x1, top, bottom and text of characters, and x0, top, x1, bottom
    of boxes. A page's boxes are gathered to one row before they meet its
    characters, so characters are not multiplied. A line is a third of the top, rounded.
    """
    gathered = boxes.groupBy(page).agg(F.collect_list(F.struct("x0", "top", "x1", "bottom")).alias("__boxes"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = F.exists(F.coalesce("__boxes", F.array().cast(gathered.schema["__boxes"].dataType)), lambda b: x.between(b["x0"], b["x1"]) & y.between(b["top"], b["bottom"]))
    rows = chars.join(gathered, page, "left").where(~inside).withColumn("line", F.bround(F.col("top") / 3).cast("long"))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"])
    return rows.groupBy(page, "line").agg(F.array_join(letters, "").alias("text"))


def chapters(parts: DataFrame, key: str, order: str, text: str, style: str) -> DataFrame:
    """Append ``chapter`` of every part of a document: a chapter's title, or in the chapter of items 附注五-N and the item.

    First-level headings count chapters; numbered lines name one too. Inside
    chapter 五 second-level headings, numbered lines and short lines without
    punctuation are items, counted anew with each chapter. A document's parts are windowed together.
    """
    title = F.trim(F.coalesce(F.col(text), F.lit("")))
    level = lambda n: F.coalesce(F.col(style).rlike(f"Heading {n}|标题 ?{n}"), F.lit(False))
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    number, named = rf"^([{CHAPTER_DIGITS}]+)[、．.]\s*(\S.{{0,30}})", r"^\d{1,2}[．、.]\s*([一-龥][一-龥（）()A-Za-z0-9]{1,20})"
    head, numbered = level(1) & (title != ""), ~level(1) & title.rlike(number)
    digit = F.regexp_extract(title, number, 1)
    # Counting goes on from the last numbered chapter that is one digit.
    place = F.when(numbered & (F.length(digit) == 1), F.instr(F.lit(CHAPTER_DIGITS), digit))
    rows = parts.withColumn("__h", head).withColumn("__m", numbered).withColumn("__base", F.last(place, ignorenulls=True).over(over)).withColumn("__block", F.sum(place.isNotNull().cast("int")).over(over))
    rows = rows.withColumn("__seq", F.coalesce("__base", F.lit(0)) + F.sum(F.col("__h").cast("int")).over(Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.when(F.col("__h"), F.when(F.col("__seq") <= 10, F.substring(F.lit(CHAPTER_DIGITS), F.col("__seq"), F.lit(1))).otherwise(F.col("__seq").cast("string"))).when(F.col("__m"), digit)
    rows = rows.withColumn("__major", F.last(mark, ignorenulls=True).over(over)).withColumn("__title", F.last(F.when(F.col("__h"), title).when(F.col("__m"), F.trim(F.regexp_extract(title, number, 2))), ignorenulls=True).over(over))
    rows = rows.withColumn("__n", F.sum((F.col("__h") | F.col("__m")).cast("int")).over(over))
    short = F.length(title).between(2, 10) & title.rlike("[一-龥]") & ~title.rlike("[，。；：、,;:0-9]")
    begun = reduce(lambda a, b: a | b, [title.startswith(w) for w in NO_ITEM])
    item = F.when(level(2), title).when(~begun & title.rlike(named), F.regexp_extract(title, named, 1)).when(~begun & short, title)
    rows = rows.withColumn("__i", F.when(~F.col("__h") & ~F.col("__m") & (F.col("__major") == ITEM_CHAPTER) & (title != ""), item))
    inner = Window.partitionBy(key, "__n").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__k", F.count("__i").over(inner)).withColumn("__subject", F.last("__i", ignorenulls=True).over(inner))
    chapter = F.when((F.col("__major") == ITEM_CHAPTER) & (F.col("__k") > 0), F.concat(F.lit(f"附注{ITEM_CHAPTER}-"), F.col("__k").cast("string"), F.lit(" "), F.col("__subject"))).otherwise(F.coalesce("__title", F.lit("")))
    return rows.withColumn("chapter", chapter).drop("__h", "__m", "__base", "__block", "__seq", "__major", "__title", "__n", "__i", "__k", "__subject")


def with_source(results: DataFrame, sources: DataFrame, path: str, order: str, kind: str = "check_type", source: str = "source_file") -> DataFrame:
    """Results without a source file get one by their kind: statements, notes or the first file; PDFs before others."""
    name = F.lower(F.col(path))
    has = lambda words: reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    rank = F.struct((~F.col(path).endswith(".pdf")).alias("a"), F.col(order).alias("b"))
    pick = lambda words: F.min_by(F.when(has(words), F.col(path)), F.when(has(words), rank))
    best = sources.agg(pick(STATEMENT_FILES).alias("__s"), pick(NOTE_FILES).alias("__n"), F.min_by(path, order).alias("__f"))  # one row
    given = F.when(F.coalesce(source, F.lit("")) != "", F.col(source))
    wanted = F.when(F.col(kind) == "报表间", F.col("__s")).when(F.col(kind).isin(NOTE_CHECKS), F.col("__n"))
    return results.join(F.broadcast(best)).withColumn(source, F.coalesce(given, wanted, "__f", F.lit(""))).drop("__s", "__n", "__f")


def invested(payload: Column) -> Column:
    """The list of investments in a company's JSON: under invests as a list or an object with children or list, else under investList."""
    kind = "array<map<string,string>>"
    at = lambda p: F.get_json_object(payload, p)
    listed = F.when(at("$.invests").startswith("["), at("$.invests"))
    raw = F.coalesce(listed, at("$.invests.children"), at("$.invests.list"), F.when(~F.coalesce(at("$.invests"), F.lit("")).startswith("{"), at("$.investList")))
    first = lambda x, *names: F.coalesce(*[F.try_element_at(x, F.lit(n)) for n in names])
    return F.transform(F.coalesce(F.from_json(raw, kind), F.array().cast(kind)), lambda x: F.struct(first(x, "name", "investName", "company").alias("name"), first(x, "ratio", "investRatio", "percent").alias("ratio"), first(x, "id", "orgId", "orgid").alias("id")))


def dimension_codes(payload: Column) -> Column:
    """Codes of all second-level dimensions in a JSON list of classes, in their order."""
    classes = F.from_json(payload, "array<struct<children:array<struct<second_dimension_code:string>>>>")
    codes = F.flatten(F.transform(classes, lambda c: F.transform(F.coalesce(c["children"], F.array().cast("array<struct<second_dimension_code:string>>")), lambda x: x["second_dimension_code"])))
    return F.filter(codes, lambda c: c.isNotNull() & (c != ""))


def nested_contexts(payload: Column, least: int = 5) -> Column:
    """Texts under ``context`` in the lists of a JSON object's numeric keys, longer than ``least`` characters."""
    lists = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: k.rlike(r"^\d+$"))
    items = F.flatten(F.transform(F.map_values(lists), lambda v: F.coalesce(F.from_json(v, "array<struct<context:string>>"), F.array().cast("array<struct<context:string>>"))))
    return F.filter(F.transform(items, lambda i: F.trim(i["context"])), lambda c: F.length(c) > least)
