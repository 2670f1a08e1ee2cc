"""Names to records, and slices of ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_match(names: DataFrame, records: DataFrame, name: str, title: str, preferred: str, order: str) -> DataFrame:
    """The record of each name: exact title, preferred ones before others, then by ``order``."""
    over = Window.partitionBy(name).orderBy(F.desc(F.col(preferred).cast("int")), order)
    found = names.join(records, F.col(name) == F.col(title)).withColumn("__k", F.row_number().over(over))
    return found.where("__k = 1").drop("__k")


def with_fallback(names: DataFrame, first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """Records of the first source; of the second for names that it lacks; else unmatched."""
    a = names.join(first, name, "left_semi").withColumn("origin", F.lit("first"))
    rest = names.join(first, name, "left_anti")
    b = rest.join(second, name, "left_semi").withColumn("origin", F.lit("second"))
    c = rest.join(second, name, "left_anti").withColumn("origin", F.lit("none"))
    return a.unionByName(b).unionByName(c)


def last_n(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    over = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)


def contained_titles(names: DataFrame, records: DataFrame, name: str, title: str, order: str, least: int = 4) -> DataFrame:
    """The record of each name by containment: one holds the other and is under twice as long; exact titles first.

    The shorter text is looked up by its beginning, as long as the largest power
    of two it holds, among all parts of that length of the longer one: for a text of
    n characters fewer than 2 n parts, kept as hashes. What meets is verified.
    """

    def found(short: DataFrame, long: DataFrame, s: str, t: str) -> DataFrame:
        power = lambda c: F.pow(F.lit(2), F.floor(F.log2(F.length(c)))).cast("int")
        left = short.withColumn("__p", power(s)).withColumn("__h", F.xxhash64(F.expr(f"left(`{s}`, __p)")))
        widths = F.filter(F.array(power(t), (power(t) / 2).cast("int")), lambda p: p >= least)
        right = long.withColumn("__p", F.explode(widths)).withColumn("__h", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(`{t}`) - __p + 1), i -> xxhash64(substring(`{t}`, i, __p)))"))))
        return left.join(right, ["__p", "__h"]).where(F.col(t).contains(F.col(s)) & (F.length(s) * 2 > F.length(t))).select(name, "__title", order)

    n = names.where(F.length(name) >= least).select(name).distinct()
    r = records.where(F.length(title) >= least).select(F.col(title).alias("__title"), F.col(order))
    inside_name, inside_title = found(r, n, "__title", name), found(n, r, name, "__title")
    best = F.min_by(F.struct(F.col("__title"), F.col(order)), F.struct(F.abs(F.length("__title") - F.length(name)), F.col(order)))
    return inside_name.unionByName(inside_title).groupBy(name).agg(best.alias("__b")).select(name, F.col("__b.__title").alias("title"), F.col(f"__b.{order}").alias(order))


def all_terms(threads: DataFrame, text: str, asked: str) -> DataFrame:
    """Threads that contain every blank-separated term of a search text of two characters or more."""
    terms = [t for t in asked.split() if t]
    if len(asked.strip()) < 2:
        raise ValueError("a search needs two characters or more")
    found = threads
    for t in terms:
        found = found.where(F.col(text).contains(t))
    return found


def in_period(rows: DataFrame, stamp: str, period: str | None = None, annual: bool = False) -> DataFrame:
    """Rows of one reporting date, or of year ends; all if neither is asked for."""
    day = F.date_format(stamp, "yyyy-MM-dd")
    if period is not None:
        return rows.where(day == period)
    return rows.where(day.endswith("-12-31")) if annual else rows


def pending(work: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Work that the progress table has no row for."""
    return work.join(progress.select(key), key, "left_anti")


def overriding(custom: DataFrame, builtin: DataFrame, name: str) -> DataFrame:
    """Custom entries, and the built-in ones whose name no custom entry has."""
    return custom.withColumn("custom", F.lit(True)).unionByName(builtin.join(custom.select(name), name, "left_anti").withColumn("custom", F.lit(False)))


def rerank(candidates: DataFrame, query: str, item: str, score: str, second: str, k: int, overfetch: int = 3) -> DataFrame:
    """The best ``overfetch`` * k of each query by one score, of these the best k by a second."""
    over = lambda s: Window.partitionBy(query).orderBy(F.desc(s), item)
    fetched = candidates.withColumn("__k", F.row_number().over(over(score))).where(F.col("__k") <= k * overfetch).drop("__k")
    return fetched.withColumn("rank", F.row_number().over(over(second))).where(F.col("rank") <= k)


def compared(rows: DataFrame, progress: DataFrame, keys: list[str], verdict: str, missing: str = "未比对") -> tuple[DataFrame, DataFrame]:
    """Rows with the verdict that the progress table has under their whole key, and a histogram of the verdicts."""
    done = progress.groupBy(*keys).agg(F.min(verdict).alias(verdict))
    both = rows.join(done, keys, "left").withColumn(verdict, F.coalesce(verdict, F.lit(missing)))
    return both, both.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"))
