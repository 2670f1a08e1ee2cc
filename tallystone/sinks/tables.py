"""Results as JSON, partitions by dimension, text cells and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_text(df: DataFrame) -> DataFrame:
    """All columns as text for people: lists joined by ", ", booleans as 是 or 否, nulls empty."""

    def shown(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        match field.dataType:
            case T.ArrayType():
                c = F.array_join(c.cast("array<string>"), ", ")
            case T.BooleanType():
                c = F.when(c, "是").when(~c, "否")
            case T.StructType() | T.MapType():
                c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def markdown_row(cells: Column, width: int) -> Column:
    """One line of a Markdown table: backslashes, pipes and newlines escaped, short rows filled up."""
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)
    clean = F.transform(padded, lambda x: F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def write_results(results: DataFrame, path: str) -> None:
    """Check results as JSON lines."""
    results.write.mode("overwrite").json(path)


def write_dimensions(hits: DataFrame, path: str, dimension: str = "dimension") -> None:
    """One folder of CSV files for each dimension, cells as text; rows are dealt by dimension and a salt, so that a large one has many writers."""
    salted = cell_text(hits).repartition(F.col(dimension), F.pmod(F.xxhash64(*hits.columns), F.lit(16)))
    salted.write.mode("overwrite").option("header", True).partitionBy(dimension).csv(path)


def write_names(names: DataFrame, column: str, order: str, path: str) -> None:
    """A text list of names, each once where it stands first."""
    first = names.groupBy(column).agg(F.min(order).alias("__o")).orderBy("__o")
    first.select(column).write.mode("overwrite").text(path)


def first_row_columns(rows: DataFrame, order: str) -> DataFrame:
    """A single-sheet export: all columns that the first row (by ``order``) has something in, as text."""
    first = rows.orderBy(order).limit(1).first()
    kept = [c for c in rows.columns if first is not None and first[c] not in (None, "", [])]
    return cell_text(rows.select(*[F.col(f"`{c}`") for c in kept or rows.columns]))


def status_sheet(rows: DataFrame, status: str) -> DataFrame:
    """Count and percentage of each status, unknown ones as 未知."""
    counts = rows.groupBy(F.coalesce(F.col(status), F.lit("未知")).alias(status)).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("__all"))  # one row
    return counts.join(F.broadcast(total)).select(status, "n", F.round(100.0 * F.col("n") / F.col("__all"), 2).alias("pct"))


def report_lines(results: DataFrame, key: str = "result_id") -> DataFrame:
    """A Markdown report as lines (part, line): counts first, then problems, then doubts.

    Reads passed, severity, rule_name and description. Lines are rows, so a
    report of any length is written by many tasks; sort by part and key for one file.
    """
    failed = ~F.coalesce("passed", F.lit(False))
    part = F.when(failed & (F.col("severity") == "error"), 1).when(failed & (F.col("severity") == "warning"), 2)
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("string")
    head = results.agg(F.concat(F.lit("- 检查项："), F.count(F.lit(1)).cast("string"), F.lit("；问题："), one(F.coalesce(part == 1, F.lit(False))), F.lit("；存疑："), one(F.coalesce(part == 2, F.lit(False)))).alias("line"))
    rows = results.where(part.isNotNull()).select(part.alias("part"), F.col(key).cast("string").alias("key"), F.concat(F.lit("- **"), F.col("rule_name"), F.lit("** "), F.coalesce("description", F.lit(""))).alias("line"))
    return head.select(F.lit(0).alias("part"), F.lit("").alias("key"), "line").unionByName(rows)


def write_sheets(results: DataFrame, path: str, category: Column) -> None:
    """One folder of CSV files for each sheet of a result workbook, one of all items and one of the summary by sheet."""
    named = results.withColumn("sheet", category)
    write_dimensions(named, f"{path}/sheets", "sheet")
    cell_text(named).write.mode("overwrite").option("header", True).csv(f"{path}/all")
    named.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("passed")).cast("long")).alias("n_failed")).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def write_statements(statements: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """One folder a report type, rows of each in order inside a file."""
    statements.repartition(F.col(kind), F.pmod(F.xxhash64(*order), F.lit(16))).sortWithinPartitions(kind, *order).write.mode("overwrite").partitionBy(kind).parquet(path)
