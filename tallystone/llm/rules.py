"""Quality rules: learned decision lists over text statistics; DataFrame operations only.

Statistics of every whole text are computed by SQL functions. From the labelled
ones a decision list is learned by sequential covering: a conjunction of
thresholds grows literal by literal on one part of the rows by information gain,
is pruned on the other, is kept if it is precise there, and the rows that it
covers are set aside before the next one grows. Every step is one aggregation
whose result is a table of features, bins and labels, so the driver holds a
bounded number of counts. The list becomes ordered conditional expressions.

Defined cases: null and empty texts have no words and fail the base rules;
repeated rows are rows of their own; without labels of both kinds the list is
empty and only the base rules reject. Windows are compared by 64-bit hashes of
their words. Very long texts are counted whole; an empty table gives no rows; columns
named as results are replaced, others kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import fresh, held_out, saved, without

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the rules: name and SQL over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
BINS, MAX_RULES, MAX_LITERALS, LEAST_COVER, LEAST_PRECISION = 48, 8, 4, 5, 0.95


def with_stats(documents: DataFrame, text: str = "text") -> DataFrame:
    """Append STATS and drop the text; columns of these names are replaced."""
    base = without(documents, STATS)
    names = [c for c in base.columns if c != text]
    # The user's columns travel as one, so that their names meet no other.
    keep, body = ["__own"], F.coalesce(F.col("__text"), F.lit(""))
    base = base.select(F.struct(F.lit(True).alias(fresh(base, "__any")), *[F.col(f"`{c}`") for c in names]).alias("__own"), F.col(f"`{text}`").alias("__text"))
    step = base.select(
        *keep,
        F.filter(F.split(body, SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    step = step.select(
        *keep,
        "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
    )
    window = F.when(F.size("__h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__h") - WINDOW), lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)])))
    step = step.withColumn("__h", F.coalesce(window, F.array().cast("array<bigint>")))
    # Texts in which every window is new, most of them, are done here.
    step = step.withColumn("__h", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.col("__h")))
    order = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__h", order)
    twice = F.filter("__h", _same)
    step = step.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with("__at", F.slice("__at", 2, F.greatest(F.size("__at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return step.select(*[F.col(f"__own.`{c}`") for c in names], "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))


def _same(x: Column, k: Column) -> Column:
    """Does the sorted window before or after place ``k`` hash alike?"""
    before = F.when(k > 0, F.get("__h", k - 1)["h"] == x["h"])
    return F.coalesce(before, F.lit(False)) | F.coalesce(F.get("__h", k + 1)["h"] == x["h"], F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.limit if self.above else value <= self.limit


def all_of(literals: list[Literal]) -> Column:
    out = F.lit(True)
    for x in literals:
        out = out & x.column()
    return out


def verdict(rules: list[list[Literal]]) -> Column:
    """The decision list as one ordered conditional: false at the first rule that holds."""
    if not rules:
        return F.lit(True)
    out = F.when(all_of(rules[0]), F.lit(False))
    for r in rules[1:]:
        out = out.when(all_of(r), F.lit(False))
    return out.otherwise(F.lit(True))


def _limits(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature among rows of either label."""
    out: dict[str, set[float]] = {f: set() for f in FEATURES}
    shares = F.lit([i / BINS for i in range(1, BINS)])
    for r in rows.groupBy("bad").agg(*[F.percentile_approx(F.expr(e), shares, 2000).alias(f) for f, e in FEATURES.items()]).collect():
        for f in FEATURES:
            out[f].update(r[f] or [])
    return {f: sorted(v) for f, v in out.items()}


def _below(limits: list[float], value: Column) -> Column:
    return F.size(F.filter(F.lit(limits), lambda x: x < value))


def _bins(limits: dict[str, list[float]]) -> Column:
    """(feature, bin) of a row for each feature: the number of thresholds below its value."""
    parts = []
    for i, (f, e) in enumerate(FEATURES.items()):
        parts.append(F.struct(F.lit(i).alias("f"), _below(limits[f] or [0.0], F.expr(e)).alias("b")))
    return F.array(*parts)


def learn(labelled: DataFrame) -> list[list[Literal]]:
    """Sequential covering on rows with STATS, ``bad`` (0 or 1) and ``part`` (grow: true)."""
    limits, names = _limits(labelled), list(FEATURES)
    rows = saved(labelled.withColumn("__bins", _bins(limits)), "rule-rows")
    rules: list[list[Literal]] = []
    while len(rules) < MAX_RULES:
        open_ = rows.where(verdict(rules)) if rules else rows
        rule: list[Literal] = []
        while len(rule) < MAX_LITERALS:
            inside = open_.where(F.col("part") & all_of(rule))
            counts = inside.select("bad", F.explode("__bins").alias("x")).groupBy("x.f", "x.b", "bad").count().collect()
            totals = [sum(r["count"] for r in counts if r["f"] == 0 and r["bad"] == y) for y in (0, 1)]
            if totals[1] < LEAST_COVER or totals[0] == 0:
                break
            best = (0.0, None)
            for i, f in enumerate(names):
                got = {(r["b"], r["bad"]): r["count"] for r in counts if r["f"] == i}
                below = [0, 0]
                for b, limit in enumerate(limits[f]):
                    below = [below[y] + got.get((b, y), 0) for y in (0, 1)]
                    for above in (False, True):
                        good, bad = [totals[y] - below[y] for y in (0, 1)] if above else below
                        if bad < LEAST_COVER:
                            continue
                        gain = bad * (log2(bad / (bad + good)) - log2(totals[1] / (totals[0] + totals[1])))
                        if gain > best[0] + 1e-9:
                            best = (gain, Literal(f, above, limit))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Prune: the shortest beginning of the conjunction that is most precise on the other part.
        cuts = [F.sum((all_of(rule[:k]) & (F.col("bad") == y)).cast("long")).alias(f"k{k}_{y}") for k in range(1, len(rule) + 1) for y in (0, 1)]
        r = open_.where(~F.col("part")).agg(*cuts).first()
        scored = []
        for k in range(1, len(rule) + 1):
            good, bad = r[f"k{k}_0"] or 0, r[f"k{k}_1"] or 0
            scored.append(((bad + 1) / (bad + good + 2) if bad else 0.0, bad / max(1, bad + good), k))
        worth, precision, k = max(scored, key=lambda x: (round(x[0], 6), -x[2]))
        if precision < LEAST_PRECISION:
            break
        rules.append(rule[:k])
    return rules


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: statistics, the base rules' verdict and the final one."""
    stats = saved(with_stats(documents.select("doc_id", "text")), "rule-stats")
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    labelled = stats.where(~base_failed()).join(known, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    rules = learn(labelled)
    return stats.select("doc_id", *STATS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
