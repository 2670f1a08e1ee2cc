"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory; DataFrame operations only.

Units of text are sparse vectors of their words, weighted by term frequency and
inverse document frequency, counted over all words of all documents:

- Every line is scored against one-line notices. Only lines that share a word with
  some notice's prefix are: the words of a notice from the rarest on, until the
  rest alone cannot reach the threshold, so no line at the threshold is missed.
- Windows of words, as long as a template and a quarter of it apart, are scored
  against the headers that licences ask for, the notices, and licence texts of up to
  WINDOW_WORDS words, so these may be wrapped over lines, stand in comments or in a
  long line, and have code right behind them.
- Every whole text is scored against full licence texts, kept in ``licence_texts``.

An inverted index of the rarer words of headers and full texts finds the documents
that hold enough of their weight to reach the threshold; only these are scored. An
SPDX tag gives its whole expression (``MIT OR Apache-2.0``). A text that matches
GPL-3.0 but names the Affero licence in its title is AGPL-3.0.

A document's own licence is that of its best unit. A document that matches as a
whole, or at least a third of whose words stand in matching lines outside comments,
is a licence file and speaks for its directory; a header or a comment speaks for
its own file only, and so does a text that begins with a comment, unless its name
says that it is a licence file. A document without a licence of its own inherits from the
nearest ancestor directory that has a licence file, unless its name says that it is
a licence file itself or its first HEAD_LINES lines speak of a licence that was
not recognised. Directories are resolved once each, not once for each
document, and documents join them salted, as one directory may hold any share of
the rows.

Defined cases: null and empty texts have no licence of their own; equal scores
go to tags, then notices in order of names, then headers, then whole texts; of
several licence files of a directory the best scored speaks, then the smallest
path; repeated rows are rows of their own; a null path has no directory and inherits
nothing; a path without a slash lies in the root, which is above all directories;
very long texts are read whole; an empty table gives no rows; columns named as
results are replaced, others are kept whatever their names.
"""

from __future__ import annotations

import json
import re
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import fresh, salted_join, saved, without

#: Notices that licences ask to be put at the head of a file.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: The telling paragraph of the headers that licences ask for.
HEADERS = {
    "AGPL-3.0": _GNU.format("Affero General Public License", 3),
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons.",
    "GPL-2.0": _GNU.format("General Public License", 2),
    "GPL-3.0": _GNU.format("General Public License", 3),
    "LGPL-2.1": _GNU.format("Lesser General Public License", "2.1").replace("program", "library"),
    "LGPL-3.0": _GNU.format("Lesser General Public License", 3).replace("program", "library"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
THRESHOLD, FILE_SHARE, SALTS = 0.6, 3, 16
_ID = r"(?:\([ \t]*)*[A-Za-z0-9.+:-]+(?:[ \t]*\))*"
TAG = rf"SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+{_ID})*)"
#: Licence texts up to this length are sought in windows, too; a window begins every 1 / STEPS of its length.
WINDOW_WORDS, STEPS = 400, 4
#: What speaks of a licence in the head of a file, and how long the head is.
SPEAKS, HEAD_LINES = r"(?i)\b(licen[cs](e|ed|es|ing)|redistribut(e|ed|ion)|all rights reserved|public domain|spdx)\b", 40
#: How a line of a comment begins, and how files of licences are called.
COMMENT, LICENCE_NAME = r"^\s*(#|//|/\*|\*|--|;|%|<!--|\.\\\")", r"(?i)^((un)?licen[cs]es?|copying|copyright|notice)([.\-_].*)?$"
RESULTS = ["own_licence", "own_score", "is_licence_file", "licence", "inherited_from"]
NOT_WORD = "[^a-z0-9]+"


def full_texts() -> dict[str, str]:
    """Licence texts by name, read on the driver."""
    return {p.stem: p.read_text("utf-8", "replace") for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def template_words(templates: dict[str, str]) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for name in sorted(templates):
        found = [w for w in re.split(NOT_WORD, templates[name].lower()) if w]
        out[name] = {w: found.count(w) for w in sorted(set(found))}
    return out


def document_frequencies(documents: DataFrame, text: str) -> DataFrame:
    """(w, df): in how many documents a word stands, for all words; counted before the shuffle, so a common word is a row a task."""
    return documents.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))


def idf_of(frequencies: DataFrame, n: int, templates: dict[str, dict[str, int]]) -> dict[str, float]:
    """ln(1 + N / df) of the templates' words over all documents."""
    vocabulary = sorted({w for t in templates.values() for w in t})
    df = {r["w"]: r["df"] for r in frequencies.where(F.col("w").isin(vocabulary)).collect()}  # a row for each template word
    return {w: log(1 + n / max(1, df.get(w, 0))) for w in vocabulary}


def prefix_words(templates: dict[str, dict[str, int]], idf: dict[str, float], threshold: float) -> list[str]:
    """Words of which any line at the threshold has one: the rest of a template is too short a vector."""
    out: set[str] = set()
    for words in templates.values():
        weight = sorted(((tf * idf[w], w) for w, tf in words.items()), reverse=True)
        norm = sqrt(sum(x * x for x, _ in weight))
        for i, (_, w) in enumerate(weight):
            if sqrt(sum(x * x for x, _ in weight[i:])) < threshold * norm:
                break
            out.add(w)
    return sorted(out)


def line_scores(documents: DataFrame, text: str, templates: dict[str, str], threshold: float, frequencies: DataFrame, total: int) -> DataFrame:
    """(__row, __line, words, own_licence, own_score) of the lines at the threshold; needs ``__row``."""
    words = template_words(templates)
    idf = idf_of(frequencies, total, words)
    prefix = prefix_words(words, idf, threshold)
    # A plain search finds the few documents that hold such a word at all.
    some = documents.where(F.lower(F.col(text)).rlike("|".join(prefix) or "$^"))
    lines = some.select("__row", F.posexplode(F.split(text, "\n", -1)).alias("__line", "line")).withColumn("words", words_of(F.col("line")))
    lines = lines.where(F.arrays_overlap("words", F.lit(prefix)))
    n = F.when(F.col("line").rlike(COMMENT), 0).otherwise(F.size("words")).alias("n")
    terms = lines.select("__row", "__line", n, F.explode("words").alias("w")).groupBy("__row", "__line", "n", "w").count()
    terms = salted_join(terms, frequencies, "w", "__row")
    value = F.col("count") * F.log(1 + F.lit(total) / F.col("df"))
    sums = [F.sum(value * value).alias("norm")]
    for name, tf in words.items():
        own = F.create_map(*[F.lit(x) for w in sorted(tf) for x in (w, tf[w] * idf[w])])
        sums.append(F.sum(value * F.coalesce(own[F.col("w")], F.lit(0.0))).alias(f"dot_{name}"))
    scored = terms.groupBy("__row", "__line", "n").agg(*sums)
    best = []
    for i, (name, tf) in enumerate(words.items()):
        norm = sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        best.append(F.struct(F.round(F.col(f"`dot_{name}`") / (F.sqrt("norm") * norm), 6).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
    top = scored.select("__row", "__line", "n", F.array_max(F.array(*best)).alias("best")).where(F.col("best.score") >= threshold)
    return top.select("__row", "__line", "n", "best")


def table_of(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A table of the templates, broadcast: its size is that of their words."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>"))))


def index_of(spark: SparkSession, texts: dict[str, str], threshold: float, frequencies: DataFrame, total: int, place: int) -> tuple[DataFrame, DataFrame]:
    """The texts' words (w, i, v, rare) and the texts (i, name, place, norm2, rest); places begin below ``place``."""
    words = template_words(texts)
    idf = idf_of(frequencies, total, words)
    index, sizes = [], []
    for i, (name, tf) in enumerate(words.items()):
        weight = sorted((((c * idf[w]) ** 2, w) for w, c in tf.items()), key=lambda x: (idf[x[1]], x[1]))
        norm2, rest, rare = sum(x for x, _ in weight), 0.0, False
        for x, w in weight:  # the commonest words stay out while they alone cannot reach half of what is needed
            rare = rare or rest + x > threshold**2 * norm2 / 2
            rest += 0.0 if rare else x
            index.append({"w": w, "i": i, "v": sqrt(x), "rare": rare})
        sizes.append({"i": i, "name": name, "place": place - i, "norm2": norm2, "rest": rest})
    return table_of(spark, index, "w:string,i:int,v:double,rare:boolean"), table_of(spark, sizes, "i:int,name:string,place:int,norm2:double,rest:double")


def likely(documents: DataFrame, text: str, index: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(__row, i) of the documents that hold enough of a text's weight: a cosine is at most the norm of what is shared over the text's norm."""
    held = documents.select("__row", F.explode(F.array_distinct(words_of(F.col(text)))).alias("w")).join(index.where("rare"), "w")
    held = held.groupBy("__row", "i").agg(F.sum(F.col("v") * F.col("v")).alias("shared")).join(sizes, "i")
    return held.where(F.col("shared") + F.col("rest") >= threshold**2 * F.col("norm2") * (1 - 1e-9)).select("__row", "i")


def unit_scores(units: DataFrame, index: DataFrame, sizes: DataFrame, threshold: float, frequencies: DataFrame, total: int, name: str) -> DataFrame:
    """(__row, n, best) of the units (__row, __line, i, words) at the threshold, each against its template ``i``, or all where it is null."""
    key = ["__row", "__line", "__i"]
    terms = units.select("__row", "__line", F.coalesce("i", F.lit(-1)).alias("__i"), F.explode("words").alias("w")).groupBy(*key, "w").count()
    terms = salted_join(terms, frequencies, "w", "__row")
    valued = saved(terms.select(*key, "w", "count", (F.col("count") * F.log(1 + F.lit(total) / F.col("df"))).alias("value")), name)
    norms = valued.groupBy(*key).agg(F.sum("count").alias("n"), F.sum(F.col("value") * F.col("value")).alias("norm"))
    dots = valued.join(index, "w").where("__i = -1 or __i = i").groupBy(*key, "i").agg(F.sum(F.col("value") * F.col("v")).alias("dot"))
    scored = dots.join(norms, key).join(sizes, "i").select(*key, "n", F.struct(F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("norm2")), 6).alias("score"), "place", "name").alias("best"))
    return scored.groupBy(*key).agg(F.max("n").alias("n"), F.max("best").alias("best")).where(F.col("best.score") >= threshold).select("__row", "n", "best")


def windows(words: Column, length: Column, telling: Column) -> Column:
    """Runs of ``length`` words, a quarter of it apart, that hold a telling word; the whole where it is shorter."""
    last = F.greatest(F.size(words) - length, F.lit(0))
    step = F.greatest(F.floor(length / STEPS).cast("int"), F.lit(1))
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(telling, w), i)), lambda i: i.isNotNull())
    around = F.flatten(F.transform(hits, lambda i: F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: F.least(F.greatest((F.floor(i / step).cast("int") - k) * step, F.lit(0)), last))))
    starts = F.filter(F.array_distinct(F.concat(around, F.transform(F.slice(hits, F.size(hits), 1), lambda i: last))), lambda at: F.exists(hits, lambda i: (i >= at) & (i < at + length)))
    return F.transform(starts, lambda at: F.slice(words, at + 1, length))


def file_scores(documents: DataFrame, text: str, texts: dict[str, str], headers: dict[str, str], notices: dict[str, str], settled: DataFrame, threshold: float, frequencies: DataFrame, total: int, place: int) -> DataFrame:
    """(__row, n, best) of whole texts and of windows at the threshold; a window's n is 0; needs ``__row``.

    Rows that are ``settled`` have a line that no window can score above.
    """
    spark, counts = documents.sparkSession, (frequencies, total)
    lengths = {name: sum(tf.values()) for name, tf in template_words(texts).items()}
    heads = {f"header {name}": t for name, t in headers.items()} | {f"notice {name}": t for name, t in notices.items()} | {f"part {name}": t for name, t in texts.items() if lengths[name] <= WINDOW_WORDS}
    index, sizes = index_of(spark, heads | texts, threshold, *counts, place)  # headers come first by name
    is_head = F.col("name").rlike("^(header|notice|part) ")
    found = saved(likely(documents, text, index, sizes, threshold).join(sizes.select("i", "name", is_head.alias("head")), "i").select("__row", "i", "name", "head"), "licence-likely")
    whole = documents.join(found.where("not head").select("__row").distinct(), "__row", "left_semi").select("__row", F.lit(0).alias("__line"), F.lit(None).cast("int").alias("i"), words_of(F.col(text)).alias("words"))
    of = lambda head: (index.join(sizes.where(is_head if head else ~is_head).select("i"), "i"), sizes.where(is_head if head else ~is_head))
    files = unit_scores(whole, *of(False), threshold, *counts, "licence-file-terms")
    files = saved(files, "licence-whole")  # a licence's own text quotes its header

    of_head = template_words(heads)
    idf = idf_of(frequencies, total, of_head)
    # Of a window at the threshold one word at least is among a template's heaviest.
    told = [{"name": name, "length": sum(tf.values()), "telling": prefix_words({name: tf}, idf, threshold)} for name, tf in of_head.items()]
    told = table_of(spark, told, "name:string,length:int,telling:array<string>")
    wanted = found.where("head").join(files.select("__row"), "__row", "left_anti").join(settled, "__row", "left_anti").join(told, "name")
    wanted = wanted.groupBy("__row").agg(F.collect_list(F.struct("i", "length", "telling")).alias("__heads"))  # as many as there are templates at most
    parts = documents.select("__row", F.col(text).alias("__t")).join(saved(wanted, "licence-wanted"), "__row").withColumn("words", words_of(F.col("__t"))).select("__row", "words", F.explode("__heads").alias("h"))
    parts = parts.select("__row", F.col("h.i").alias("i"), F.posexplode(windows(F.col("words"), F.col("h.length"), F.col("h.telling"))).alias("__line", "words"))
    near = unit_scores(parts, *of(True), threshold, *counts, "licence-header-terms").withColumn("n", F.lit(0).cast("long"))
    plain = F.struct("best.score", "best.place", F.regexp_replace("best.name", "^(header|notice|part) ", "").alias("name")).alias("best")
    return files.unionByName(near).select("__row", "n", plain)


def expression(text: Column) -> Column:
    """The expression of an SPDX tag, without brackets around the whole; empty without a tag."""
    found = F.regexp_replace(F.regexp_extract(text, TAG, 1), r"[ \t]+", " ")
    bare = F.regexp_replace(found, r"^\( ?([^()]*?) ?\)$", "$1")
    # Closing brackets that nothing opened belong to the text around.
    return F.when(~bare.contains("("), F.regexp_replace(bare, r"[ \t]*\)", "")).otherwise(bare)


def folder(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_union(above, F.array(F.lit("")))


def scan(documents: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, texts: dict[str, str] | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """All rows with RESULTS and without the text; columns of these names are replaced."""
    base = without(documents, RESULTS)
    names = [c for c in base.columns if c != text]
    # The user's columns travel as one, so that their names meet no other.
    own = F.struct(F.lit(True).alias(fresh(base, "__any")), *[F.col(f"`{c}`") for c in names]).alias("__own")
    # Numbers of rows have to be fixed before two passes use them, texts are kept by the table.
    base = base.select(own, F.col(f"`{path}`").cast("string").alias("__path"), F.col(f"`{text}`").cast("string").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    base, text, path = saved(base, "licence-documents"), "__text", "__path"
    notices, texts, headers = templates or TEMPLATES, full_texts() if texts is None else texts, HEADERS if headers is None else headers
    counts = saved(document_frequencies(base, text), "licence-frequencies"), base.count()
    lines = saved(line_scores(base, text, notices, threshold, *counts).select("__row", "n", "best"), "licence-lines")
    if texts or headers:
        found = file_scores(base, text, texts, headers, notices, lines.where("best.score >= 1").select("__row").distinct(), threshold, *counts, -len(notices))
        lines = lines.unionByName(saved(found, "licence-files"))
    tag = F.struct(F.lit(1.0).alias("score"), F.lit(1).alias("place"), expression(F.col(text)).alias("name"))
    # Saved, so that the join below sees how few rows match and does not move the texts.
    lines = lines.unionByName(saved(base.where(F.col(text).rlike(TAG)).select("__row", F.lit(0).cast("long").alias("n"), tag.alias("best")), "licence-tags"))
    matched = lines.groupBy("__row").agg(F.max("best").alias("best"), F.sum("n").alias("in_lines"))
    n = F.coalesce(F.size(words_of(F.col(text))), F.lit(0))
    named = F.coalesce(F.regexp_extract(path, "[^/]*$", 0).rlike(LICENCE_NAME), F.lit(False))
    is_file = (F.col("in_lines") > 0) & (F.col("in_lines") * FILE_SHARE >= n) & (named | ~F.col(text).rlike(COMMENT))
    affero = (F.col("best.name") == "GPL-3.0") & (F.col("in_lines") > 0) & F.lower(F.substring(text, 1, 300)).contains("affero general public")
    title = F.when(affero, "AGPL-3.0").otherwise(F.col("best.name"))
    hits = base.join(matched, "__row").select("__row", F.col("best").withField("name", title).alias("best"), is_file.alias("is_file"), path)
    hits = saved(hits, "licence-hits")

    # One licence file speaks for a directory: the best scored, then the smallest path.
    rank = F.struct((-F.col("best.score")).alias("s"), (-F.col("best.place")).alias("p"), F.col(path).alias("f"))
    spoken = hits.where("is_file").withColumn("__dir", folder(F.col(path))).where("__dir is not null").groupBy(F.col("__dir").alias("__from")).agg(F.min_by("best.name", rank).alias("__name"))

    dirs = base.select(folder(F.col(path)).alias("__dir")).where("__dir is not null").distinct()
    above = dirs.select("__dir", F.posexplode(ancestors(F.concat("__dir", F.lit("/")))).alias("__far", "__from"))
    near = above.join(spoken, "__from").groupBy("__dir").agg(F.min_by(F.struct("__from", "__name"), "__far").alias("__near"))
    near = near.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    unsaid = F.coalesce(F.substring_index(text, "\n", HEAD_LINES).rlike(SPEAKS), F.lit(False))
    rows = base.select("__own", "__row", (named | unsaid).alias("__silent"), folder(F.col(path)).alias("__dir"), F.pmod("__row", F.lit(SALTS)).cast("int").alias("__salt"))
    rows = rows.join(hits.select("__row", "best", "is_file"), "__row", "left").join(near, ["__dir", "__salt"], "left")
    inherits = F.col("best").isNull() & ~F.col("__silent")
    return rows.select(
        "__own",
        F.col("best.name").alias("own_licence"),
        F.col("best.score").alias("own_score"),
        F.coalesce("is_file", F.lit(False)).alias("is_licence_file"),
        F.coalesce("best.name", F.when(inherits, F.col("__near.__name"))).alias("licence"),
        F.when(inherits, F.col("__near.__from")).alias("inherited_from"),
    ).select(*[F.col(f"__own.`{c}`") for c in names], *RESULTS)


def report(documents: DataFrame) -> DataFrame:
    """Every document, filed at /source/language/thousand/id."""
    at = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return scan(documents.select("doc_id", "text", at.alias("path")))


#: The same in SQL, with the templates' words written out by ``oracle``.
def oracle() -> str:
    """DuckDB SQL for ``report``."""
    words = template_words(TEMPLATES)
    values = ", ".join(f"('{name}', '{w}', {tf}, {-i})" for i, (name, t) in enumerate(words.items()) for w, tf in t.items())
    return f"""
with recursive template(name, w, tf, place) as (values {values}),
docs as (select doc_id, text, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || cast(floor(doc_id / 1000) as bigint) || '/' || doc_id as path from documents),
tokens as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') as ws from docs),
df as (select w, count(*) as df from (select doc_id, unnest(list_distinct(ws)) as w from tokens) where w in (select w from template) group by w),
total as (select count(*) as n from documents),
weight as (select name, t.w, tf, place, ln(1 + n / greatest(1, coalesce(df, 0))) as idf from template t cross join total left join df on df.w = t.w),
norms as (select name, place, sqrt(sum((tf * idf) * (tf * idf))) as norm from weight group by all),
lines as (select doc_id, line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from docs) where regexp_matches(lower(line), '{"|".join(sorted({w for t in words.values() for w in t if w in ("licensed", "license", "released", "apache", "gnu", "mit", "nc", "cc", "by", "public", "general", "version", "under", "work", "this")}))}')),
terms as (select doc_id, line_no, w, count(*) as c from (select doc_id, line_no, unnest(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '')) as w from lines) group by all),
valued as (select terms.*, c * coalesce(i.idf, ln(1 + n)) as v from terms cross join total left join (select distinct w, idf from weight) i on i.w = terms.w),
line_norm as (select doc_id, line_no, sqrt(sum(v * v)) as norm, cast(sum(c) as bigint) as n from valued group by all),
dots as (select doc_id, line_no, name, place, sum(v * tf * idf) as dot from valued join weight on weight.w = valued.w group by all),
scored as (select d.doc_id, d.line_no, d.name, d.place, round(dot / (l.norm * m.norm), 6) as score, l.n from dots d join line_norm l using (doc_id, line_no) join norms m using (name)),
best_line as (select * from scored where score >= {THRESHOLD} qualify row_number() over (partition by doc_id, line_no order by score desc, place desc) = 1),
own as (select doc_id, arg_max(name, (score, place)) as name, max(score) as score, arg_max(place, (score, place)) as place, sum(n) as in_lines from best_line group by doc_id),
hits as (select own.*, path, regexp_replace(path, '/[^/]*$', '') as dir, in_lines * {FILE_SHARE} >= len(ws) as is_file from own join docs using (doc_id) join tokens using (doc_id)),
spoken as (select dir, name from hits where is_file qualify row_number() over (partition by dir order by score desc, place desc, path) = 1),
dirs as (select distinct regexp_replace(path, '/[^/]*$', '') as dir from docs),
above as (select dir, dir as up, 0 as far from dirs union all select dir, regexp_replace(up, '/[^/]*$', ''), far + 1 from above where up <> ''),
near as (select above.dir, up, name from above join spoken on spoken.dir = above.up qualify row_number() over (partition by above.dir order by far) = 1)
select d.doc_id, d.path, h.name as own_licence, h.score as own_score, coalesce(h.is_file, false) as is_licence_file, coalesce(h.name, n.name) as licence, case when h.name is null then n.up end as inherited_from
from docs d left join hits h on h.doc_id = d.doc_id left join near n on n.dir = regexp_replace(d.path, '/[^/]*$', '')
 and not coalesce(regexp_matches(array_to_string(string_split(text, chr(10))[1:{HEAD_LINES}], chr(10)), '{SPEAKS}'), false)
"""
