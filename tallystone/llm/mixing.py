"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only.

A document's size is its number of words. Sources in code-point order (null
last) weigh 1, 2, 3, repeating, and share all words by weight; a target stops at
CAP times its source's size and the excess is shared again until no target is
above. A source takes complete epochs of all its documents first. The rest of
its target is filled in the order of exponential keys -ln(u) / w, with u drawn
from the document's id and w its quality weight: documents are taken until their
prefix sum reaches the budget, and the last one is cut there, so a source's
taken words differ from its target by less than one word.

The quality weight is learned from labels: the naive Bayes chance that a document
is good, given the bands of its characters a word and of its share of symbols,
counted over all labelled documents outside the held-out fold, and LEAST_WEIGHT at
least. Without labels of both kinds all documents weigh the same.

A source may hold any share of all rows: the range of keys in which its budget
ends is narrowed by quantiles and sums until it holds ORDERED rows or so, and only
those are ordered.

Defined cases: null and empty texts have size 0 and take 0 words; repeated rows
are rows of their own; ties in the keys are ordered by id, size and the row's
hash, and rows that are equal in all columns take equally; an empty table gives
no rows; columns named as results are replaced, others are kept whatever their
names; null labels and ids teach nothing; very long texts are counted whole.
"""

from __future__ import annotations

from math import exp, inf, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import held_out, saved, without

WORD = r"[^\x20\x09-\x0D]+"
CAP, SEED = 3, 11
LEAST_WEIGHT = 0.1
#: Rows of a source that are ordered, and pieces its range of keys is cut into at a time.
ORDERED, PIECES = 1000, 32
#: Last bands of the two features.
LENGTHS, SYMBOLS = 40, 20
RESULTS = ["size", "source_size", "target", "taken"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bands(text: Column, size: Column) -> Column:
    """(characters a word, share of symbols) in bands; 0 for texts without words."""
    n = F.nullif(size, F.lit(0))
    length = F.least(F.lit(LENGTHS), F.floor(2 * F.length(text) / n) + 1)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    share = F.least(F.lit(SYMBOLS), F.floor(2 * F.log2(1 + 1000 * symbols / F.nullif(F.length(text), F.lit(0)))) + 1)
    return F.struct(F.coalesce(length, F.lit(0)).cast("int").alias("length"), F.coalesce(F.when(n.isNotNull(), share), F.lit(0)).cast("int").alias("symbols"))


def weights(order: DataFrame, labels: DataFrame | None) -> list[list[float]] | None:
    """Log odds of a good document by band: a table for each feature, the first with the prior.

    ``order`` has id and bands of all documents. The driver gets a count for
    each feature, band and label.
    """
    if labels is None:
        return None
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").alias("y"))
    seen = order.join(known, "id").groupBy("bands", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    totals = [sum(r["n"] for r in seen if r["y"] == y) for y in (0, 1)]
    if not all(totals):
        return None
    out = []
    for feature, last in (("length", LENGTHS), ("symbols", SYMBOLS)):
        counts = [[1.0] * (last + 1) for _ in (0, 1)]
        for r in seen:
            counts[r["y"]][r["bands"][feature]] += r["n"]
        out.append([log(good / (totals[1] + last + 1)) - log(bad / (totals[0] + last + 1)) for bad, good in zip(*counts, strict=True)])
    prior = log(totals[1] / totals[0])
    return [[x + prior for x in out[0]], out[1]]


def quality_weight(found: Column, odds: list[list[float]] | None) -> Column:
    """From LEAST_WEIGHT to 1."""
    if odds is None:
        return F.lit(1.0)
    chance = [[round(1 / (1 + exp(-max(-30.0, min(30.0, a + b)))), 9) for b in odds[1]] for a in odds[0]]
    table = F.array(*[F.array(*[F.lit(max(LEAST_WEIGHT, x)) for x in line]) for line in chance])
    return table[found["length"]][found["symbols"]]


def targets(sizes: dict[str | None, int], cap: int = CAP) -> dict[str | None, float]:
    """Water filling: shares by weight of all words, none above ``cap`` times its source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_, rest = list(order), float(sum(sizes.values()))
    while open_:
        per = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def with_draws(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns as one, ``row``, with the source of each, its size, id, bands, uniform draw and hash."""
    base = without(documents, RESULTS)
    own = [F.col(f"`{c}`") for c in base.columns]
    id_ = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    u = (F.pmod(F.xxhash64(F.lit(SEED), F.col(doc_id).cast("string")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    out = base.select(F.struct(*own).alias("row"), n_words(F.col(text)).alias("size"), id_.alias("id"), u.alias("u"), F.xxhash64(*own).alias("h"))
    return out.withColumn("bands", bands(F.col(f"row.`{text}`"), F.col("size")))


def order_of(odds: list[list[float]] | None) -> Column:
    """What orders a source's documents: the exponential key, id, size, and a hash of the row."""
    return F.struct((-F.log("u") / quality_weight(F.col("bands"), odds)).alias("key"), "id", F.col("size").alias("n"), "h")


def narrowed(order: DataFrame, plan: dict[str | None, tuple[int, int]]) -> dict[str | None, tuple[float, float, int]]:
    """For each source (lo, hi, words before): its budget ends among keys above lo and up to hi.

    ``plan`` has budget and rows of each source. The driver gets PIECES numbers
    for a source and pass; a pass leaves the PIECES-th part of a range's rows.
    """
    spark, kind = order.sparkSession, order.schema["source"].dataType
    spans = {s: (-1.0, inf, 0) for s, (budget, _) in plan.items() if budget > 0}
    wide = {s for s in spans if plan[s][1] > ORDERED}
    rows = {s: plan[s][1] for s in wide}
    while wide:
        names = T.StructType([T.StructField("s", kind), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
        table = F.broadcast(spark.createDataFrame([(s, *spans[s][:2]) for s in wide], names))  # a row for each source
        inside = order.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") > F.col("lo")) & (F.col("key") <= F.col("hi")))
        at = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
        cuts = {r[0]: sorted(set(r[1])) for r in inside.groupBy("source").agg(F.percentile_approx("key", at, F.lit(1000)).alias("q")).collect()}
        names = T.StructType([T.StructField("c", kind), T.StructField("cuts", T.ArrayType(T.DoubleType()))])
        table = F.broadcast(spark.createDataFrame(list(cuts.items()), names))
        piece = F.size(F.filter("cuts", lambda c: c < F.col("key"))).alias("piece")
        sums = inside.join(table, F.col("source").eqNullSafe(F.col("c"))).groupBy("source", piece).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        for s in list(wide):
            lo, hi, before = spans[s]
            edges = [lo, *cuts[s], hi]
            for r in sorted((r for r in sums if r[0] == s), key=lambda r: r["piece"]):
                if before + r["n"] >= plan[s][0]:
                    spans[s] = (edges[r["piece"]], edges[r["piece"] + 1], before)
                    if r["rows"] <= ORDERED or r["rows"] == rows[s]:  # equal keys are not cut
                        wide.discard(s)
                    rows[s] = r["rows"]
                    break
                before += r["n"]
    return spans


def cutoffs(order: DataFrame, plan: dict[str | None, tuple[int, int]], odds: list[list[float]] | None) -> DataFrame:
    """(s, cut, each): where each source's budget ends in its order.

    ``order`` has the draws of all rows. Rows that nothing tells apart share
    what is left evenly.
    """
    order = order.withColumn("order", order_of(odds)).withColumn("key", F.col("order.key"))
    spans = [(s, *span, plan[s][0]) for s, span in narrowed(order, plan).items()]
    names = T.StructType([T.StructField("s", order.schema["source"].dataType), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("before", T.LongType()), T.StructField("budget", T.LongType())])
    table = F.broadcast(order.sparkSession.createDataFrame(spans, names))  # a row for each source
    inside = order.join(table, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") > F.col("lo")) & (F.col("key") <= F.col("hi")))
    alike = inside.groupBy("s", "order", "before", "budget").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m"))
    at = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = alike.withColumn("at", at).where("at < budget and at + n >= budget")
    return ends.select("s", F.col("order").alias("cut"), F.floor((F.col("budget") - F.col("at")) / F.col("m")).cast("long").alias("each"))


def mix(documents: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows with size, source_size, target and taken; columns of these names are replaced.

    ``labels`` (doc_id, quality) teach the weights. A first pass saves sizes and
    draws without the texts; weights and cutoffs follow from it, and a second
    pass over the documents compares each with its source's cutoff, so texts are
    neither shuffled nor copied. Sources are the mixture's components: the
    driver holds a few numbers for each.
    """
    spark, rows = documents.sparkSession, with_draws(documents, doc_id, text)
    of = F.col(f"row.`{source}`")
    order = saved(rows.select(of.alias("source"), "size", "id", "u", "h", "bands"), "mix-order")
    odds = weights(order, labels)
    totals = order.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    goal = targets({r[0]: r["n"] for r in totals})
    plan = {r[0]: (*_epochs(goal[r[0]], r["n"]), r["n"], r["rows"]) for r in totals}
    names = T.StructType([T.StructField("name", order.schema["source"].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("epochs", T.LongType())])
    planned = spark.createDataFrame([(s, n, goal[s], epochs) for s, (epochs, _, n, _) in plan.items()], names)
    ends = cutoffs(order, {s: (budget, n_rows) for s, (_, budget, _, n_rows) in plan.items()}, odds)
    planned = planned.join(F.broadcast(ends), F.col("name").eqNullSafe(F.col("s")), "left")
    out = rows.withColumn("order", order_of(odds)).join(F.broadcast(planned), of.eqNullSafe(F.col("name")))
    part = F.when(F.col("order") < F.col("cut"), F.col("size")).when(F.col("order") == F.col("cut"), F.col("each")).otherwise(F.lit(0))
    return out.select("row.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def _epochs(target: float, size: int) -> tuple[int, int]:
    """Complete epochs, and the words left for the fractional one."""
    words = round(target)
    return (words // size, words % size) if size else (0, 0)


def mixed(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mixture itself: a document once for every epoch that takes it, whole or in part."""
    own = without(documents, RESULTS).columns
    rows = mix(documents, labels)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    again = rows.select(*[F.col(f"`{c}`") for c in own], F.explode(F.array_repeat(F.lit(1), copies)))
    return again.select(*[F.col(f"`{c}`") for c in own])


def report(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The contract's columns for every document."""
    return mix(documents.select("doc_id", "source", "text"), labels).select("doc_id", *RESULTS)
