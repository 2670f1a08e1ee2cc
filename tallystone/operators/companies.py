"""Whose report it is: company names in a text and where they have to agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legal forms at the end of names, and words that stand for a name.
LEGAL_FORMS = ["集团有限公司", "股份有限公司", "有限责任公司", "有限公司", "合伙企业", "集团"]
CORE_ENDINGS = ["有限公司", "股份有限公司", "集团有限公司", "股份公司", "公司", "集团"]
FULL_FORMS = ["有限公司", "股份有限公司", "有限责任公司", "集团有限公司", "合伙企业"]
PRONOUNS = ["本", "该", "贵", "各", "其", "乃", "我"]
NAME = "([一-龥A-Za-z0-9]{2,30}(?:" + "|".join(FULL_FORMS) + "))"
#: A line that names a group or a company.
HEADING = "(?m)^.*(?:集团|公司).*$"


def legal_name(name: Column) -> Column:
    """A name up to the end of its legal form, tried in the listed order; without one as it is. Null becomes empty."""
    text = F.coalesce(name, F.lit(""))
    cuts = [F.when(text.contains(form), F.concat(F.substring_index(text, form, 1), F.lit(form))) for form in LEGAL_FORMS]
    return F.trim(F.coalesce(*cuts, text))


def core_name(name: Column) -> Column:
    """A name without the first listed ending it has."""
    text = F.coalesce(name, F.lit(""))
    cuts = [F.when(text.endswith(end), F.substring(text, F.lit(1), F.length(text) - len(end))) for end in CORE_ENDINGS]
    return F.trim(F.coalesce(*cuts, text))


def prepared_by(text: Column) -> Column:
    """What stands behind 编制单位; empty without it."""
    return F.coalesce(F.regexp_extract(text, r"编制单位\s*[:：]\s*([^\s,，。；;]+)", 1), F.lit(""))


def period_of(text: Column) -> Column:
    """The first year or date of a report, blanks dropped; empty without one."""
    return F.regexp_replace(F.coalesce(F.regexp_extract(text, r"(\d{4}\s*年度|\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)", 1), F.lit("")), r"\s+", "")


def _apart(a: Column, b: Column) -> Column:
    """Two cores of which neither holds the other."""
    return (a != "") & (b != "") & ~a.contains(b) & ~b.contains(a)


def company_consistency(reports: DataFrame, key: str, text: str, listed: str) -> DataFrame:
    """Whether a report's structural names are those of its main company.

    The main one is the core name found most often in the text (the first of
    equals by code point); pronouns and single characters are no names. Compared
    are the preparer and the listed company with it, and the heading with the
    preparer. Names that hold each other agree. Without any name in the text the
    listed one meets the preparer. One row a report: main_core, n_mentions,
    n_conflicts, passed, severity. Names are counted inside their row by one fold
    over the sorted mentions; nothing is shuffled.
    """
    mentions = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(NAME), 1), core_name)
    names = F.filter(mentions, lambda n: (F.length(n) >= 2) & ~n.rlike("^[" + "".join(PRONOUNS) + "]"))
    rows = reports.select(
        key, names.alias("names"), legal_name(prepared_by(F.col(text))).alias("preparer"), legal_name(F.col(listed)).alias("listed"),
        legal_name(F.trim(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), HEADING, 0))).alias("heading"),
    )
    # Equal names stand together: the run at hand and the longest run so far, of equals the first.
    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("run"), F.lit("").alias("n"), F.lit(0).alias("k"))

    def follow(state: Column, name: Column) -> Column:
        run = F.when(state["name"] == name, state["run"] + 1).otherwise(1)
        longer = run > state["k"]
        return F.struct(name.alias("name"), run.alias("run"), F.when(longer, name).otherwise(state["n"]).alias("n"), F.when(longer, run).otherwise(state["k"]).alias("k"))

    best = F.aggregate(F.array_sort("names"), start, follow)
    rows = rows.withColumn("__b", best)
    preparer, named, heading, main = core_name(F.col("preparer")), core_name(F.col("listed")), core_name(F.col("heading")), F.col("__b.n")
    conflicts = _apart(preparer, main).cast("int") + _apart(named, main).cast("int") + _apart(heading, preparer).cast("int")
    alone = ((preparer != "") & (named != "") & (preparer != named)).cast("int")
    n = F.when(main == "", alone).otherwise(conflicts)
    return rows.select(key, main.alias("main_core"), F.col("__b.k").alias("n_mentions"), n.alias("n_conflicts"), (n == 0).alias("passed"), F.when(n == 0, "info").otherwise("warning").alias("severity"))
