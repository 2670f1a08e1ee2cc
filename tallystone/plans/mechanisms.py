"""Queries of automata, formulas that differ by row, files, pages, layouts and what is found along two axes."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tallystone.functions import formulas
from tallystone.operators import audit, display, documents, graph, related, report, retrieval, statements, terms
from tallystone.plans.registry import query
from tallystone.plans.reports import TABLES, _tables
from tallystone.session import shared_path
from tallystone.sinks import cache, files, workbooks
from tallystone.sources import library, markup, office, paged

money = lambda c: F.col(c).cast("decimal(18,2)")


def words(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def picked(place: Column, *options) -> Column:
    out = F.when(place == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(place == i, option)
    return out


@query("""
with w as (select distinct unnest(string_split_regex(text, '\\s+')) as term from benchmark)
select doc_id, term, cast(position(term in text) - 1 as int) as start from documents join w on length(term) >= 5 and contains(text, term)""")
def q137_terms_in_texts(t):
    """Every word of the benchmark's texts in every document, inside words, too: the first place."""
    known = t("benchmark").select(F.explode(F.split("text", r"\s+")).alias("term")).where(F.length("term") >= 5)
    return terms.contained(t("documents"), ["doc_id"], "text", known).select("doc_id", "term", "start")


@query("""
with s as (select distinct substr(unnest(string_split_regex(text, '\\s+')), 1, 6) as subject from benchmark)
select doc_id, subject from documents join s on length(subject) = 6 and (contains(text, subject) or contains(case when doc_id % 2 = 0 then 'about ' || reverse(substr(text, 1, 40)) else lang end, subject))""")
def q138_subjects_of_tables(t):
    """Documents as tables: a name or a header, and a row a line."""
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("about "), F.reverse(F.substring("text", 1, 40)))).otherwise("")
    rows = F.transform(F.split("text", "\n"), lambda x: F.array(x, F.lit("anders")))
    tables = t("documents").select("doc_id", name.alias("name"), F.array("lang").alias("headers"), rows.alias("rows"))
    subjects = t("benchmark").select(F.explode(F.split("text", r"\s+")).alias("word")).select(F.substring("word", 1, 6).alias("subject")).where(F.length("subject") == 6)
    return terms.subject_tables(tables, ["doc_id"], "name", "headers", "rows", subjects)


@query(TABLES + """
select k, len(list_filter(rows[1:10], lambda r: regexp_matches(array_to_string(r, ' '), '营业收入|营业利润|利润总额|净利润|人民币'))) as n_lines from t where n_lines > 2""")
def q139_summary_tables(t):
    return terms.summary_tables(_tables(t), ["k"], "rows", ["营业收入", "营业利润", "利润总额", "净利润", "人民币"])


@query("""
with r as (select l_orderkey, l_linenumber as n, cast(l_quantity as bigint) as q, l_partkey % 97 as p, l_orderkey % 9 as k from lineitem)
select l_orderkey, n, k, case k when 0 then q + n * p when 1 then (q + n) * p - 1 when 2 then q - n * n when 3 then cast(floor(q / n) as bigint) % 5 when 5 then 2 ** n - q / 4.0 when 6 then q - floor(q / -7.0) * -7 + p when 7 then n * (p // 3) when 8 then 2 ** (n % 3) ** 2 end::double as v from r""".replace("2 ** (n % 3) ** 2", "pow(2, pow(n % 3, 2))").replace("2 ** n", "pow(2, n)"))
def q140_row_formulas(t):
    """A formula of numbers for every line, of nine shapes, one of which divides by zero."""
    q, n, p, k = F.col("q"), F.col("n"), F.col("p"), F.col("k")
    shapes = [
        words(q, " + ", n, " * ", p), words("(", q, "+", n, ")*", p, "-1"), words("-", n, " ** 2 + ", q), words(q, "//", n, "%5"), words(q, "/(", n, "-", n, ")"), words("2**", n, "-", q, "/4"), words(q, " % -7 + ", p), words("--", n, "*(", p, "//3)"),
        words("2**", n % 3, "**2"),
    ]
    rows = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 97).alias("p"), (F.col("l_orderkey") % 9).alias("k"))
    return rows.select("l_orderkey", "n", "k", formulas.evaluate(picked(k, *shapes)).alias("v"))


@query("""
with c as (select c_custkey as k, cast(c_acctbal as decimal(18,2)) as b from customer)
select k, case k % 5 when 0 then cast(b - k as varchar) when 1 then cast(cast(3 * (b + k) as decimal(18,2)) as varchar) when 2 then 'n' || k when 3 then cast(b as varchar) end as value from c""")
def q141_note_values(t):
    k, b = F.col("c_custkey"), money("c_acctbal")
    shown = F.format_number(b, 2)
    entry = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pairs])
    values = picked(k % 5, entry("账面余额", shown, "坏账准备", k, "账面价值", "1"), entry("余额", shown, "余额合计", k), entry("账面余额", "-", "期末余额小计", words("n", k)), entry("账面价值", b, "坏账准备", "x"), entry("甲", k))
    formula = picked(k % 5, "账面余额-坏账准备=账面价值", "(余额 + 余额合计) * 3", "账面余额-坏账准备", "账面价值-坏账准备", "期末余额")
    field = picked(k % 5, "账面价值", "账面价值", "年末余额", "账面价值", "年末余额")
    return t("customer").select(k.alias("k"), formulas.note_value(formula, field, values).alias("value"))


@query("""
with recursive f as (select user_id, event_type, row_number() over (partition by user_id order by min(event_id)) - 1 as lane from events group by user_id, event_type),
e as (select user_id, event_id, lane, row_number() over (partition by user_id order by event_id) as i from events join f using (user_id, event_type)),
w as (
 select user_id, i, event_id, lane, 0 as row_no, [lane] as taken from e where i = 1
 union all
 select e.user_id, e.i, e.event_id, e.lane, case when hit then w.row_no + 1 else w.row_no end, case when hit then [e.lane] else list_append(w.taken, e.lane) end
 from w join e on e.user_id = w.user_id and e.i = w.i + 1, lateral (select list_contains(w.taken, e.lane) or len(list_filter(w.taken, lambda x: x > least(w.lane, e.lane) and x < greatest(w.lane, e.lane))) > 0 as hit))
select user_id, event_id, cast(lane as int) as lane_no, cast(row_no as int) as row_no, cast(120 + lane * 280 as int) as x, cast(220 + row_no * 170 as int) as y, 70 as height from w""")
def q142_diagram_layout(t):
    """A user's events as a diagram: each goes to the next one, lanes by kind."""
    nodes = t("events").withColumns({"next": F.lit(None).cast("array<string>"), "kind": F.lit("process"), "docs": F.lit("")})
    return graph.layout(nodes, "user_id", "event_id", "event_id", "event_type", "next", "kind", "docs")


@query("""
select doc_id, strlen(text) as length, length(text) as n_chars, md5(text) as digest from documents where doc_id % 3 < 2 and strlen(text) > 100""")
def q143_document_files(t):
    """Documents written as files of three kinds and read back, two kinds and those over 100 bytes only."""
    docs = t("documents").where("text is not null")
    name = words(F.pmod(F.col("doc_id"), F.lit(50)), "/doc-", F.col("doc_id"))
    path = shared_path(docs.sparkSession, "document-files")
    files.write_files(docs.select(F.concat(name, picked(F.col("doc_id") % 3, ".md", ".txt", ".pdf")).alias("name"), F.col("text").alias("content")), path)
    read = library.read_documents(docs.sparkSession, path).where(F.col("extension").isin("md", "txt") & (F.col("length") > 100) & F.col("error").isNull())
    return read.select(F.regexp_extract("path", r"doc-(-?\d+)\.", 1).cast("long").alias("doc_id"), "length", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def _pages(t, size: int = 150) -> str:
    """Orders as pages of a list, newest first: every day is numbered, and the days' sizes are summed before it."""
    rows = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_orderstatus").alias("status"))
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    newer = Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0))).drop("n")  # a row a day
    placed = rows.join(days, "date").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("date").orderBy("id")) - 1)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "date", "status"))), lambda r: F.struct(r["id"].alias("id"), r["date"].alias("date"), r["status"].alias("status")))
    pages = placed.groupBy(F.floor(F.col("place") / size).alias("page")).agg(listed.alias("rows")).join(F.broadcast(total))
    path = shared_path(rows.sparkSession, "order-pages")
    files.write_files(pages.select(words("page-", F.col("page") + 1, ".json").alias("name"), F.to_json(F.struct("total", "rows")).alias("content")), path)
    return path


@query("select cast(o_orderkey as varchar) as id, cast(cast(o_orderdate as date) as varchar) as date, o_orderstatus as status from orders where cast(o_orderdate as date) >= date '1997-06-15'")
def q144_paged_since(t):
    spark = t("orders").sparkSession
    return paged.listed(spark, _pages(t), "1997-06-15").select("id", "date", "status")


@query("""
with c as (select c_nationkey as nation, c_mktsegment as sheet, c_custkey as k, c_name as name from customer)
select nation, sheet, count(*) as n, min(k) as first, md5(string_agg(k || ':' || name, ',' order by k)) as digest from c group by all""")
def q145_workbooks(t):
    """A workbook a nation with a sheet a segment, written and read back."""
    rows = t("customer")
    path = shared_path(rows.sparkSession, "nation-workbooks")
    files.write_files(workbooks.workbooks(rows, "c_nationkey", F.col("c_mktsegment"), "c_custkey", ["c_custkey", "c_name"]), path)
    cells = office.read_office(rows.sparkSession, path).where((F.col("table_name") != workbooks.SUMMARY_SHEET) & (F.col("row_no") > 0))
    line = F.struct(F.get("cells", F.lit(0)).cast("long").alias("k"), F.get("cells", F.lit(1)).alias("name"))
    found = cells.select(F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("int").alias("nation"), F.col("table_name").alias("sheet"), line.alias("r"))
    texts = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat_ws(":", r["k"], r["name"]))
    return found.groupBy("nation", "sheet").agg(F.count(F.lit(1)).alias("n"), F.min("r.k").alias("first"), F.md5(F.array_join(texts, ",")).alias("digest"))


@query("""
with c as (select c_custkey as k from customer)
select k, cast(k as varchar) as result_id, case when k % 4 = 1 then null else 'error' end as severity, case when k % 4 = 2 then null else k % 2 = 0 end as passed, null as problem from c where k % 4 < 3
union all select k, null, null, null, case when k % 8 = 3 then 'no JSON' else 'no object' end from c where k % 4 = 3""")
def q146_result_files(t):
    k = F.col("c_custkey")
    first = words('{"meta": {"n": 1}, "results": [{"result_id": "', k, '", "severity": "error", "passed": ', F.when(k % 2 == 0, "true").otherwise("false"), "}]}")
    text = picked(k % 4, first, words('{"results": [{"result_id": ', k, ', "passed": false}]}'), words('{"meta": 5, "results": [{"passed": "odd", "severity": "error", "result_id": "', k, '"}]}'), F.when(k % 8 == 3, words("{", k)).otherwise(words("[", k, "]")))
    found, problems = library.load_results(t("customer").select(words(k).alias("path"), text.alias("text")))
    none = lambda kind: F.lit(None).cast(kind)
    bad = problems.select(F.col("path").cast("long").alias("k"), none("string").alias("result_id"), none("string").alias("severity"), none("boolean").alias("passed"), "problem")
    return found.select(F.col("path").cast("long").alias("k"), "result_id", "severity", "passed", none("string").alias("problem")).unionByName(bad)


@query("""
select event_id, case event_type when 'click' then 'B' when 'error' then 'C' when 'view' then 'A' end as pattern, case when event_type in ('click', 'error', 'view') then event_id % 13 <> 0 end as passed from events""")
def q147_header_roles(t):
    """Headers told one role each: 期初余额 and 期末余额 make no relation, 期初数 and 期末数 do."""
    kind, v, k = F.col("event_type"), money("value"), (F.col("event_id") % 10).cast("decimal(18,2)")
    off = F.when(F.col("event_id") % 13 == 0, F.lit("0.50").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    names = lambda *x: F.array(*[F.lit(n) for n in x])
    cells = lambda *x: F.array(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    headers = F.when(kind == "view", names("项目", "余额", "坏账准备", "账面价值")).when(kind == "click", names("项目", "期初数", "本期增加", "本期减少", "期末数")).when(kind == "error", names("原值", "累计折旧", "减值", "净值")).otherwise(names("项目", "期初余额", "本期增加", "本期减少", "期末余额"))
    row = F.when(kind == "view", cells("x", v, words("约", k, "元"), v - k + off)).when(kind == "click", cells("x", v, k, "-", v + k + off)).when(kind == "error", cells(v, k, "", v - k + off)).otherwise(cells("x", v, k, "-", v + k))
    rows = t("events").select("event_id", headers.alias("headers"), row.alias("cells"))
    return report.cross_foot_tables(rows, "headers", "cells", chain=True).select("event_id", "pattern", "passed")


@query("""
with o as (select o_custkey as report, o_orderkey as k, case when o_orderkey % 11 = 0 then null else year(cast(o_orderdate as date)) end as y, 3 + o_orderkey % 7 as w from orders)
select m.report, m.k, min(c.k) as prior from o m left join o c on c.report = m.report and c.y is not null and (m.y is null or c.y < m.y) and abs(c.w - m.w) <= 2 and c.k % 4 = 0 where m.k % 4 <> 0 group by all""")
def q148_prior_matrices(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("report"), k.alias("k"), F.when(k % 11 != 0, F.year(F.col("o_orderdate").cast("date"))).alias("y"), (3 + k % 7).alias("w"))
    return statements.prior_matrices(rows.where("k % 4 <> 0"), rows.where("k % 4 = 0"), "report", "k", "y", "w")


@query("""
with x as (select o_custkey as report, o_orderkey as k, case o_orderkey % 5 when 0 then '' when 1 then '合并利润表（' || o_orderkey || '）' else '附注' || o_orderkey end as name, o_orderkey % 5 = 0 and o_orderkey % 2 = 0 as telling from orders),
r as (select distinct report, unnest(['利润表', '附注' || max(k) || '的说明', '合并资产负债表', cast(min(k) as varchar), '无此表']) as ref from x group by report),
n as (select r.report, ref, min(k) as k from r join x on x.report = r.report and not regexp_matches(ref, '^[0-9]+$') and name <> '' and (contains(name, ref) or contains(ref, name)) group by all),
b as (select r.report, ref, min(k) as k from r join x on x.report = r.report and telling and ref = '合并资产负债表' group by all)
select r.report, r.ref, case when regexp_matches(r.ref, '^[0-9]+$') then cast(r.ref as bigint) when n.k is not null then n.k else b.k end as k, case when regexp_matches(r.ref, '^[0-9]+$') then 'id' when n.k is not null then 'name' when b.k is not null then 'words' end as stage
from r left join n on n.report = r.report and n.ref = r.ref left join b on b.report = r.report and b.ref = r.ref""")
def q149_tables_by_reference(t):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "").when(k % 5 == 1, words("合并利润表（", k, "）")).otherwise(words("附注", k))
    rows = F.when((k % 5 == 0) & (k % 2 == 0), F.array(F.array(F.lit("流动资产合计"), F.lit("1")), F.array(F.lit("非流动资产合计")), F.array(F.lit("x"), F.lit("资产总计")))).otherwise(F.array(F.array(F.lit("资产总计"))))
    tables = t("orders").select(F.col("o_custkey").alias("report"), k.alias("k"), name.alias("name"), rows.alias("rows"))
    asked = tables.groupBy("report").agg(F.max("k").alias("hi"), F.min("k").alias("lo")).select("report", F.explode(F.array(F.lit("利润表"), words("附注", F.col("hi"), "的说明"), F.lit("合并资产负债表"), words(F.col("lo")), F.lit("无此表"))).alias("ref"))
    return statements.tables_by_reference(asked, tables.withColumn("o", F.col("k")), "report", "ref", "k", "o", "name", "rows")


@query("""
with k as (select o_orderkey as k, cast(o_totalprice as decimal(18,2)) as v from orders)
select k, case when k % 3 = 0 then 'r1' else 'r2' end as row, case when k % 5 = 0 then 'total' else 'a' end as "column", case when k % 7 = 0 then 1.5 else -2.0 end::double as off from k where k % 2 = 0
""".replace("case when k % 3 = 0 then 'r1' else 'r2' end", "case when k % 3 = 0 then 'movement' else 'closing' end"))
def q150_matrix_closure(t):
    """Statements of changes in equity of two parts, every second one with one wrong cell: which, and by how much."""
    k, v = F.col("k"), F.col("v")
    base = t("orders").select(F.col("o_orderkey").alias("k"), money("o_totalprice").alias("v"))
    value = {"opening": (v, k), "movement": (k, F.lit(7)), "closing": (v + k, k + 7)}
    wrong_row, wrong_column = F.when(k % 3 == 0, "movement").otherwise("closing"), F.when(k % 5 == 0, "total").otherwise("a")
    parts = []
    for row, (a, b) in value.items():
        for column, x in (("a", a), ("b", b), ("total", a + b)):
            hit = (k % 2 == 0) & (wrong_row == row) & (wrong_column == column)
            off = F.when(hit, F.when(k % 7 == 0, F.lit("1.5").cast("decimal(18,2)")).otherwise(F.lit("-2").cast("decimal(18,2)"))).otherwise(F.lit(0).cast("decimal(18,2)"))
            parts.append(F.struct(F.lit(row).alias("row"), F.lit(column).alias("column"), F.lit("total" if column == "total" else "part").alias("ck"), (x.cast("decimal(18,2)") + off).cast("string").alias("value")))
    cells = base.select("k", F.explode(F.array(*parts)).alias("c")).select("k", "c.*").withColumn("rk", F.col("row"))
    breaks = audit.matrix_closure(cells, "k", "row", "column", "rk", "ck", "value")
    return audit.broken_cells(cells, breaks, "k", "row", "column", "rk", "ck").withColumn("off", F.col("off").cast("double"))


@query("select doc_id, length(text) as n_chars, md5(text) as digest, true as fits, true as follows from documents where length(text) > 0")
def q151_overlapping_chunks(t):
    """Texts cut into cores with overlaps: put together again, no core over its size, every overlap what follows."""
    pieces = retrieval.chunks(t("documents").where("text is not null"), "doc_id", "text", "generic")
    whole = retrieval.reassembled(pieces, "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
    after = F.lead("core").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    held = pieces.withColumn("after", after).groupBy("doc_id").agg(F.min(F.length("core") <= 800).alias("fits"), F.min(F.col("overlap") == F.coalesce(F.substring("after", 1, 120), F.lit(""))).alias("follows"))
    return whole.join(held, "doc_id")


@query("""
select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) = '' as empty, md5(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)) as content,
 case when page_id % 5 = 0 then '' else '<div>' || url || '<br></div>' || repeat('<div x="1">', page_id % 4) || page_id || repeat('</div>', page_id % 4) || '<DIVIDE/>' end as body from pages""".replace("page_id % 4)", "cast(page_id % 4 as int))"))
def q152_article_bodies(t):
    """The article of a page, and the body of nested elements, some of which are never closed."""
    k = F.col("page_id")
    nested = F.concat(F.lit('<html><div id="a">x</div><div id="b" class="pages_content" y><div>'), "url", F.lit("<br></div>"), F.expr("repeat('<div x=\"1\">', cast(page_id % 4 as int))"), k.cast("string"), F.expr("repeat('</div>', cast(page_id % 4 as int))"), F.lit("<DIVIDE/>"))
    page = F.concat(nested, F.when(k % 5 == 0, "").otherwise("</div><div>tail</div></html>"))
    content = markup.main_content(F.col("html"))
    return t("pages").select("page_id", (content == "").alias("empty"), F.md5(content).alias("content"), markup.article_body(page).alias("body"))


@query("""
with c as (select distinct p_brand || ':' || p_size as content, p_brand, p_size from part)
select p_size, count(*) as n_missing from c where p_size % 3 <> 0 group by 1""")
def q153_annotation_cache(t):
    """Tables that a cache does not know by their content, after two versions of it were written."""
    spark = t("part").sparkSession
    rows = t("part").select("p_size", cache.table_hash(F.lit(None), F.col("p_brand"), F.lit(""), F.array(F.lit("a")), F.array(F.array(F.col("p_size").cast("string")))).alias("hash"))
    root = shared_path(spark, "annotations")
    known = rows.select("hash", F.lit("{}").alias("annotation"), "p_size")
    cache.write(spark, root, "m", known.where("p_size % 6 = 0"))
    cache.write(spark, root, "m", known.where("p_size % 6 = 3"))
    return cache.missing(rows, cache.read(spark, root, "m")).groupBy("p_size").agg(F.count(F.lit(1)).alias("n_missing"))


@query("""
with p as (select l_orderkey as e, 'P' || l_partkey as v, max(l_suppkey % 4 in (1, 2)) as x, max(l_suppkey % 4 = 0) as l from lineitem where l_partkey not in (select min(l_partkey) from lineitem) group by all),
m as (select a.e, a.v, a.l and b.l as legal, not (a.l and b.l) and (a.x or b.x) as high, b.e as other from p a join p b on a.v = b.v and a.e <> b.e),
c as (select v, min(e) as class_id from p group by v)
select e as entity, v as value, class_id, case when legal then 'legal_person' else 'person' end as dimension, case when legal or high then 3 else 2 end as level, count(*) as n_links from m join c using (v) group by all""")
def q154_shared_people(t):
    """Orders as companies that share parts in several roles, tested pair by pair."""
    role = picked(F.col("l_suppkey") % 4, "legal_person", "core_team", "main_person", "shareholder")
    people = t("lineitem").select(F.col("l_orderkey").alias("entity"), words("P", F.col("l_partkey")).alias("value"), role.alias("role"))
    return related.shared_people(people, t("lineitem").agg(words("P", F.min("l_partkey")).alias("value")))


@query("select o_custkey, o_orderstatus, arg_min(case when o_orderkey % 5 = 3 then ' ' else o_orderstatus || o_orderkey end, o_orderkey) as value from orders where o_orderkey % 5 > 2 group by all")
def q155_first_filled(t):
    value = picked(F.col("o_orderkey") % 5, "", "-", "—", " ", words(F.col("o_orderstatus"), F.col("o_orderkey")))
    rows = t("orders").withColumn("v", F.when(F.col("o_orderkey") % 5 > 0, value))
    return statements.first_filled(rows, ["o_custkey", "o_orderstatus"], "o_orderkey", "v").withColumnRenamed("v", "value")


@query("select p_partkey from part where p_partkey % 4 in (2, 3)")
def q156_terms_of_the_trade(t):
    """Findings whose word is broken by blanks, or whose suggestion is a term, go; longer words that hold one stay."""
    k = F.col("p_partkey")
    rows = t("part").select("p_partkey", picked(k % 4, "金融机 构", words("x", k), "现金流理表", words("净利润", k)).alias("original"), picked(k % 4, "金融", "所得 税", words("y", k), "z").alias("suggestion"))
    return terms.without_terms(rows).select("p_partkey")


@query("""
with c as (select conv_id, turn, role, case when turn % 3 = 0 then '相反' || text when turn % 3 = 1 then text || chr(10) || '争议' || turn else text end as text from conversations),
f as (select conv_id, turn, role, unnest(list_transform(regexp_extract_all(text, '(?:矛盾|相反|但实际上|然而.*?不同|争议).{0,100}'), lambda m: substr(m, 1, 80))) as m from c)
select conv_id, array_to_string(list(role || ': ' || m order by turn)[1:5], '|') as places from f group by 1""")
def q157_contradictions(t):
    turn = F.col("turn")
    text = F.when(turn % 3 == 0, F.concat(F.lit("相反"), "text")).when(turn % 3 == 1, F.concat("text", F.lit("\n争议"), turn.cast("string"))).otherwise(F.col("text"))
    found = display.contradictions(t("conversations").withColumn("text", text), "conv_id", "turn", "role", "text")
    return found.select("conv_id", F.array_join("places", "|").alias("places"))


@query("""
with c as (select c_custkey as k from customer)
select k, k % 5 >= 3 as has_models, k % 2 = 1 as has_limits, k % 3 = 0 as has_style, k % 7 < 3 as has_boundary, k % 11 < 5 as has_tension, k % 4 < 2 as mostly_primary,
 (k % 5 >= 3)::int + (k % 2 = 1)::int + (k % 3 = 0)::int + (k % 7 < 3)::int + (k % 11 < 5)::int + (k % 4 < 2)::int as gates_passed from c""")
def q158_profile_gates(t):
    k = F.col("c_custkey")
    part = lambda on, text: F.when(on, F.lit(text)).otherwise("")
    models = F.concat(*[part(k % 5 >= i, f"### 模型{i}\n") for i in range(1, 5)])
    text = F.concat(
        models, part(k % 2 == 1, "局限\n"), part(k % 3 == 0, "## 表达DNA\n句式 词汇 语气\n"), F.lit("## 诚实边界\n"), part(k % 7 < 3, "- a\n- b\n- c\n"), F.lit("## 来源\n"), part(k % 4 < 2, "一手 一手 二手\n"), part(k % 4 >= 2, "二手 一手 二手\n"),
        part(k % 11 < 5, "## 其他\n张力 矛盾"),
    )
    return documents.persona_gates(t("customer").select(k.alias("k"), text.alias("text")), "text").drop("text")
