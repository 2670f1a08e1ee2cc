"""Layers of related-party checks: fingerprints, people, profiles, equity, history and relation types.

Companies meet by equality on what they share. A shared value is aggregated to
a class before it meets its members, so no layer lists all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions import numbers, text
from tallystone.operators import linkage
from tallystone.session import shared_path

HIGH, MEDIUM, LOW = 3, 2, 1
#: Words of addresses in residential buildings.
RESIDENTIAL = ["小区", "花园", "公寓", "苑", "村", "组"]
#: Levels of what companies share.
LEVELS = {
    "phone": HIGH, "email": HIGH, "email_domain": HIGH, "address": HIGH, "same_building": MEDIUM, "website": MEDIUM, "legal_person": HIGH, "executive": HIGH,
    "person": MEDIUM, "controller": HIGH, "beneficiary": HIGH, "shareholder": MEDIUM, "trademark": MEDIUM, "software": MEDIUM, "wechat": LOW,
}


def building(address: Column) -> Column:
    """An address up to its street number, if that is eight characters or more."""
    core = F.regexp_extract(text.normal_address(address), r"^(.*?(?:路|街|道|巷|弄)\d+号)", 1)
    return F.when(F.length(core) >= 8, core)


def contacts(companies: DataFrame, key: str) -> DataFrame:
    """(entity, dimension, value) of phones, mails, private domains, addresses, buildings and hosts.

    Reads columns phone, email, address and website; one pass, no shuffle.
    """
    mails = text.emails(F.coalesce("email", F.lit("")))
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    values = F.create_map(
        F.lit("phone"), text.phones(F.col("phone")), F.lit("email"), mails, F.lit("email_domain"), text.private_domains(mails), F.lit("address"), one(text.normal_address(F.col("address"))),
        F.lit("same_building"), one(building(F.col("address"))), F.lit("website"), one(text.host(F.col("website"))),
    )
    rows = companies.select(F.col(key).alias("entity"), F.explode(values).alias("dimension", "__v"))
    return rows.select("entity", "dimension", F.explode("__v").alias("value"))


def phone_segments(companies: DataFrame, key: str) -> DataFrame:
    """Links of landlines with their area code that differ in the last digit only: HIGH.

    The test is on pairs, so a number shared with one company is no bar to the
    segment's others. Companies that share a number besides are linked by it at
    the same level; their segment link is not taken off.
    """
    numbers_of = companies.select(F.col(key).alias("entity"), F.explode(text.phones(F.col("phone"))).alias("number"))
    return linkage.adjacent(numbers_of, "entity", "number").withColumn("dimension", F.lit("phone_segment"))


def address_prefixes(companies: DataFrame, key: str) -> DataFrame:
    """Companies whose normal address goes on from another one of eight characters or more: MEDIUM."""
    rows = companies.select(F.col(key).alias("entity"), text.normal_address(F.col("address")).alias("place"))
    found = linkage.prefixes(rows, "entity", "place")
    return found.select("entity", "class_id", F.col("n_prefixes").alias("n_links"), F.lit("address_prefix").alias("dimension"), F.lit(MEDIUM).alias("level"))


def without_excluded(marks: DataFrame, excluded: DataFrame) -> DataFrame:
    """Marks whose value is not on a list of public bodies and persons; names of one character are none."""
    return marks.where(F.length("value") >= 2).join(excluded.select("value"), "value", "left_anti")


#: Links from which on a value counts as very common; there is at most one such value for that many marks.
COMMON = 100_000


def linked(marks: DataFrame, levels: dict[str, int] = LEVELS, common: int = COMMON) -> DataFrame:
    """Members of classes that share a value in a dimension: class id, number of links, level. One shuffle for all dimensions.

    Classes of values with ``common`` links or more are few and are broadcast, so no task
    holds such a value's members; all other classes may be as many as the marks, and are merged.
    Marks are dealt over all shuffle partitions: they compress so well that, by their
    bytes, a few tasks would be given too many of them.
    """
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = marks.where(F.col("value").isNotNull() & (F.col("value") != "")).select("entity", "dimension", "value").repartition(n, "entity", "value").distinct()
    classes = rows.groupBy("dimension", "value").agg(F.min("entity").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links")).where("n_links > 0")
    level = F.try_element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), F.col("dimension"))
    cold = rows.join(F.broadcast(classes.where(F.col("n_links") >= common).select("dimension", "value")), ["dimension", "value"], "left_anti").join(classes.where(F.col("n_links") < common).hint("merge"), ["dimension", "value"])
    hot = rows.join(F.broadcast(classes.where(F.col("n_links") >= common)), ["dimension", "value"])
    return cold.unionByName(hot).withColumn("level", level)


def crossed(left: DataFrame, right: DataFrame, dimension: str, level: int) -> DataFrame:
    """Entities of ``left`` whose value is a value of others in ``right``, as for former names, invested companies and pledges.

    ``n_links`` counts the other entities; ``class_id`` is their smallest, or
    where that is the entity itself the largest. A value's entities are counted before
    the join, so each row of ``left`` meets one row.
    """
    theirs = right.select("entity", "value").distinct()
    sizes = theirs.groupBy("value").agg(F.count(F.lit(1)).alias("__n"), F.min("entity").alias("__low"), F.max("entity").alias("__high"))
    own = theirs.withColumn("__own", F.lit(1))
    both = left.select("entity", "value").distinct().join(sizes, "value").join(own, ["entity", "value"], "left")
    n = F.col("__n") - F.coalesce("__own", F.lit(0))
    other = F.when(F.col("__low") != F.col("entity"), F.col("__low")).otherwise(F.col("__high"))
    return both.where(n > 0).select("entity", "value", other.alias("class_id"), n.alias("n_links"), F.lit(dimension).alias("dimension"), F.lit(level).alias("level"))


def profile(companies: DataFrame, since: int = 2018, capital: float = 1e6, insured: int = 5, scope: int = 10) -> DataFrame:
    """Append flags, n_flags and level of companies' profiles: young, small, few insured, residential, no scope.

    Reads founded, capital, insured, address and scope (texts). Two flags or
    more are MEDIUM, one is LOW, none is null. The year is a parameter.
    """
    flag = lambda name, c: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    lives = reduce(lambda a, b: a | b, [F.col("address").contains(w) for w in RESIDENTIAL])
    flags = F.array_compact(F.array(
        flag("young", numbers.found_year(F.col("founded")) >= since), flag("small_capital", numbers.parse_capital(F.col("capital")) < capital), flag("few_insured", F.regexp_extract("insured", r"\d+", 0).try_cast("int") < insured),
        flag("residential", lives), flag("no_scope", F.length(F.coalesce("scope", F.lit(""))) < scope),
    ))
    out = companies.withColumn("flags", flags).withColumn("n_flags", F.size("flags"))
    return out.withColumn("level", F.when(F.col("n_flags") >= 2, MEDIUM).when(F.col("n_flags") == 1, LOW))


def investments(edges: DataFrame, companies: DataFrame, name: str = "name") -> DataFrame:
    """Edges (parent, child) whose both ends are companies at hand."""
    known = companies.select(F.col(name).alias("__n")).distinct().hint("merge")
    pairs = edges.distinct()
    return pairs.join(known, pairs["child"] == known["__n"], "left_semi").join(known, pairs["parent"] == known["__n"], "left_semi")


def relation_type(trades: DataFrame, targets: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Append ``relation``: in_group, target_counterparty (one end is a target) or hidden."""
    inside = targets.select(F.col(name)).distinct().withColumn("__in", F.lit(True))
    rows = trades
    for end in (a, b):
        rows = rows.join(inside.select(F.col(name).alias(end), F.col("__in").alias(f"__{end}")), end, "left")
    x, y = F.coalesce(f"__{a}", F.lit(False)), F.coalesce(f"__{b}", F.lit(False))
    return rows.withColumn("relation", F.when(x & y, "in_group").when(x | y, "target_counterparty").otherwise("hidden")).drop(f"__{a}", f"__{b}")


def first_party(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first pledge or mortgage of each company."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def intangibles(marks: DataFrame, generic: DataFrame) -> DataFrame:
    """Links by shared trademarks, software and accounts; generic labels are left out."""
    return linked(marks.join(generic.select("value"), "value", "left_anti"))


#: Roles of people in a company; the executives' ones make a shared person a HIGH link.
EXECUTIVES, LEGAL = ["core_team", "main_person"], "legal_person"


def shared_people(people: DataFrame, excluded: DataFrame) -> DataFrame:
    """Links by people that two companies share, from (entity, value, role): class id, n_links, dimension and level.

    A shared legal person, the same in both, is HIGH and no shared person besides.
    Any other shared person is HIGH where either company has it as an executive,
    else MEDIUM; an entity has a row for each level. Names on the list of public
    bodies and persons and names of one character are none. Names are counted by
    kind before they meet their companies, so no pairs are made.
    """
    marks = people.select("entity", F.trim("value").alias("value"), "role").where(F.length("value") >= 2).join(excluded.select("value"), "value", "left_anti")
    one = marks.groupBy("entity", "value").agg(F.max(F.col("role").isin(EXECUTIVES)).alias("x"), F.max(F.col("role") == LEGAL).alias("l"))
    n = lambda c: F.sum(c.cast("long"))
    x, l = F.col("x"), F.col("l")
    sizes = one.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("class_id"), n(l).alias("n_l"), n(x).alias("n_x"), n(x & ~l).alias("n_xo"), n(~l).alias("n_o")).where("n > 1")
    both = one.join(sizes, "value")
    # Partners that count: all others, but for a legal person those only that have it in another role.
    partners = F.when(l, F.col("n_o")).otherwise(F.col("n") - 1)
    high = F.when(x, partners).when(l, F.col("n_xo")).otherwise(F.col("n_x"))
    found = F.array(
        F.struct(F.lit("legal_person").alias("dimension"), F.lit(HIGH).alias("level"), F.when(l, F.col("n_l") - 1).otherwise(0).alias("n_links")),
        F.struct(F.lit("person").alias("dimension"), F.lit(HIGH).alias("level"), high.alias("n_links")),
        F.struct(F.lit("person").alias("dimension"), F.lit(MEDIUM).alias("level"), (partners - high).alias("n_links")),
    )
    return both.select("entity", "value", "class_id", F.explode(found).alias("f")).select("entity", "value", "class_id", "f.*").where("n_links > 0")


def isolated(rules: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(the rules' rows with their ``rule``, the error of each rule that failed): one rule's failure leaves the others.

    Every rule is run and kept in the shared folder, so that what fails while
    rows are made is known before the union; rules may have different columns.
    """
    out, errors = None, {}
    for name, rule in rules.items():
        try:
            rows = rule().withColumn("rule", F.lit(name))
            path = shared_path(rows.sparkSession, "rule")
            rows.write.parquet(path)
            kept = rows.sparkSession.read.schema(rows.schema).parquet(path)
        except Exception as e:  # noqa: BLE001 - whatever a rule raises is its own failure
            errors[name] = str(e).splitlines()[0]
            continue
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    return out, errors
