"""Entities linked by shared fingerprints: classes and link counts, not all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared(entities: DataFrame, key: str, value: str, dimension: str, level: int) -> DataFrame:
    """Members of classes that share a value: class id (the smallest key) and number of links.

    A class is aggregated before it meets its members, so a value of any share
    of the rows makes one row for each member.
    """
    rows = entities.where(F.col(value).isNotNull() & (F.col(value) != "")).select(F.col(key).alias("entity"), F.col(value).alias("value")).distinct()
    classes = rows.groupBy("value").agg(F.min("entity").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links")).where("n_links > 0")
    return rows.join(classes, "value").select("entity", "value", "class_id", "n_links", F.lit(dimension).alias("dimension"), F.lit(level).alias("level"))


def adjacent(entities: DataFrame, key: str, number: str) -> DataFrame:
    """As ``shared``, for landlines (leading 0, ten digits or more) that differ in the last digit, and only there.

    Links are to other numbers of the segment: entities with the same number are
    no neighbours of each other. Mobile numbers have no segments.
    """
    landline = F.col(number).startswith("0") & (F.length(number) >= 10)
    rows = entities.where(landline).select(F.col(key).alias("entity"), F.col(number).alias("number"), F.expr(f"substring({number}, 1, length({number}) - 1)").alias("value")).distinct()
    same = rows.groupBy("value", "number").agg(F.count(F.lit(1)).alias("n_same"), F.min("entity").alias("first"))
    segments = same.groupBy("value").agg(F.sum("n_same").alias("n_all"), F.min("first").alias("class_id"))
    sizes = same.join(segments, "value").select("value", "number", "class_id", (F.col("n_all") - F.col("n_same")).alias("n_links")).where("n_links > 0")
    return rows.join(sizes, ["value", "number"]).select("entity", "value", "class_id", "n_links", F.lit("segment").alias("dimension"), F.lit(3).alias("level"))


def prefixes(entities: DataFrame, key: str, name: str, least: int = 8) -> DataFrame:
    """Names that begin with another, shorter one of ``least`` characters or more.

    Every prefix of a name that is as long as some name is looked up among the names
    by equality. Names are as many as the entities, so they are merged, not broadcast.
    """
    rows = entities.where(F.length(name) >= least).select(F.col(key).alias("entity"), F.col(name).alias("name"))
    stems = rows.groupBy(F.col("name").alias("stem")).agg(F.min("entity").alias("class_id"))
    lengths = rows.agg(F.collect_set(F.length("name"))).scalar()  # one row
    shorter = F.filter("__lengths", lambda n: n < F.length("name"))
    cuts = rows.withColumn("__lengths", lengths).select("entity", F.explode(F.transform(shorter, lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("stem"))
    found = cuts.join(stems.hint("merge"), "stem")
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_prefixes"), F.min_by("class_id", F.length("stem")).alias("class_id"))


def roll_up(hits: list[DataFrame]) -> DataFrame:
    """One row for each linked entity: highest level, links, dimensions and verdict."""
    rows = reduce(DataFrame.unionByName, hits)
    out = rows.groupBy("entity").agg(F.max("level").alias("max_level"), F.sum("n_links").alias("n_links"), F.array_join(F.array_sort(F.collect_set("dimension")), "|").alias("dimensions"))
    return out.withColumn("verdict", F.when(F.col("max_level") == 3, "related").when(F.col("max_level") == 2, "suspicious").otherwise("minor"))


def reconcile_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Full outer comparison of two name lists: matched, missed or extra."""
    a = left.select(name).distinct().withColumn("__left", F.lit(True))
    b = right.select(name).distinct().withColumn("__right", F.lit(True))
    status = F.when(F.col("__left") & F.col("__right"), "matched").when(F.col("__left"), "missed").otherwise("extra")
    return a.join(b, name, "full").select(name, status.alias("status"))


def likely_names(left: DataFrame, right: DataFrame, name: str, order: str, width: int = 4) -> DataFrame:
    """(name, likely): for names that the right list lacks, the first right name that holds their first ``width`` characters, or null.

    Names are compared without blanks and with half-width parentheses. The parts of
    the right names are reduced to one row a part before they meet the left ones.
    """
    bare = lambda c: F.translate(F.regexp_replace(c, r"\s+", ""), "（）", "()")
    theirs = right.select(bare(F.col(name)).alias("__b"), F.col(name).alias("likely"), F.col(order).alias("__o"))
    parts = F.array_distinct(F.expr(f"flatten(transform(sequence(1, least({width}, length(__b))), w -> transform(sequence(1, length(__b) - w + 1), i -> substring(__b, i, w))))"))
    first = theirs.where("__b <> ''").select(F.explode(parts).alias("__p"), "likely", "__o").groupBy("__p").agg(F.min_by("likely", "__o").alias("likely"))
    missed = left.select(name, bare(F.col(name)).alias("__b")).distinct().join(theirs.select("__b").distinct(), "__b", "left_anti")
    return missed.withColumn("__p", F.substring("__b", 1, width)).join(first, "__p", "left").select(name, "likely")
