"""Queries of statement, report, related-party, document, graph and retrieval rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.formulas import compile_formula, is_subsequence
from tallystone.operators import documents, graph, matching, related, report, statements, terms
from tallystone.plans.registry import query
from tallystone.sinks import store, tables
from tallystone.streaming import ingest

money = lambda c: F.col(c).cast("decimal(18,2)")


def words(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("with e as (select user_id, event_type, event_id, case when value < 20 then 0 else value end as v from events) select user_id, event_type, arg_max(v, (v <> 0, event_id)) as v from e group by all")
def q41_last_unless_zero(t):
    rows = t("events").withColumn("v", F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")))
    return statements.last_unless_zero(rows, ["user_id", "event_type"], "event_id", "v")


@query("""
with c as (select o_custkey, arg_min(cast(o_totalprice as decimal(18,2)), o_orderkey) as v from orders where o_orderstatus = 'F' group by 1), p as (select o_custkey, arg_min(cast(o_totalprice as decimal(18,2)), o_orderkey) as v from orders where o_orderstatus = 'O' group by 1)
select o_custkey, coalesce(cast(c.v as varchar), '') as current, coalesce(cast(p.v as varchar), '') as prior from c full join p using (o_custkey)""")
def q42_matrix_statement(t):
    rows = t("orders").withColumn("v", money("o_totalprice"))
    return statements.matrix_statement(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey", "v")


@query("""
with b as (select l_suppkey as stmt, sum(cast(l_extendedprice as decimal(18,2))) - sum(cast(l_discount as decimal(18,2))) - sum(cast(l_tax as decimal(18,2))) - sum(cast(l_quantity as decimal(18,2))) as e from lineitem group by 1),
r as (select stmt, e, e + case when stmt % 5 = 0 then 0.05 else 0 end as a from b)
select stmt, 'R5' as rule_id, cast(e as double) as expected, cast(a as double) as actual, cast(abs(e - a) as double) as difference, e = a as passed,
 case when e = a then 'info' when stmt % 3 <> 0 then 'warning' else 'error' end as severity, cast(case when stmt % 3 = 0 then 0 else 10 end as int) as n_missing_optional from r""")
def q43_operating_profit(t):
    total = lambda c: F.sum(money(c))
    b = t("lineitem").groupBy(F.col("l_suppkey").alias("stmt")).agg(total("l_extendedprice").alias("营业收入"), total("l_discount").alias("营业成本"), total("l_tax").alias("税金及附加"), total("l_quantity").alias("q"))
    off = F.when(F.col("stmt") % 5 == 0, F.lit("0.05").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    b = b.withColumn("营业利润", F.col("营业收入") - F.col("营业成本") - F.col("税金及附加") - F.col("q") + off)
    b = b.withColumn("信用减值损失", F.when(F.col("stmt") % 4 == 0, -F.col("q")).otherwise(F.col("q")))  # printed with either sign
    named = ["营业收入", "营业成本", "税金及附加", "营业利润", "信用减值损失"]
    rest = [n for _, n, required in statements.OPERATING_PROFIT.terms if not required and n not in named] + ["资产减值损失"]
    items = [F.col(n).cast("decimal(24,4)").alias(n) for n in named] + [F.when(F.col("stmt") % 3 == 0, F.lit(0)).cast("decimal(24,4)").alias(n) for n in rest]
    return statements.operating_profit(b.unpivot("stmt", items, "item", "current"))


@query("""
with r as (select case when o_orderkey % 11 = 0 then 'none' when o_orderkey % 3 <> 0 or o_orderkey % 7 = 0 then 'flows' else 'with_exchange' end as stage from orders)
select stage, stage <> 'none' as passed, count(*) as n from r group by all""")
def q44_cash_two_stages(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(money("o_totalprice").alias("operating"), (-F.col("o_custkey")).cast("decimal(18,2)").alias("investing"), F.lit(10).cast("decimal(18,2)").alias("financing"), (k % 7 * 5).cast("decimal(18,2)").alias("exchange"), k.alias("k"))
    off = F.when(F.col("k") % 3 == 0, F.col("exchange")).otherwise(0) + F.when(F.col("k") % 11 == 0, 1).otherwise(0)
    rows = rows.withColumn("increase", F.col("operating") + F.col("investing") + F.col("financing") + off)
    return statements.cash_increase(rows, ["operating", "investing", "financing"], "exchange", "increase").groupBy("stage", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("select case when o_orderpriority like '%URGENT%' then 'now' when o_orderpriority like '%HIGH%' then 'now' when o_orderpriority like '%LOW%' then 'later' end as family, count(*) as n from orders group by 1")
def q45_family_dispatch(t):
    return statements.dispatch(t("orders"), "o_orderpriority", [("URGENT", "now"), ("HIGH", "now"), ("LOW", "later")]).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("""
select case when contains(html, 'track(1)') or contains(html, 'lang="de"') then 'four_statements' when regexp_matches(html, '[0-9]{2}') and len(regexp_extract_all(html, '<p>')) >= 2 then 'note_detail' else 'title' end as class,
 (contains(html, 'aulich')::int + contains(html, 'the')::int + contains(html, 'that')::int) >= 2 as several, count(*) as n from pages group by all""")
def q46_table_classes(t):
    html = F.col("html")
    found = statements.table_class(html, F.regexp_count(html, F.lit("<p>")), html.rlike("[0-9]{2}"), ["track(1)", 'lang="de"'])
    rows = t("pages").select(found.alias("class"), statements.several_currencies(html, ["aulich", "the", "that"]).alias("several"))
    return rows.groupBy("class", "several").agg(F.count(F.lit(1)).alias("n"))


@query("""
with l as (select l_orderkey, case when l_linenumber = 7 then -1 else 1 end as sign, cast(l_extendedprice as decimal(18,2)) as price, cast(l_quantity as decimal(18,2)) as quantity from lineitem),
c as (select l_orderkey, 'price' as col, sign * price as v from l union all select l_orderkey, 'quantity', sign * quantity from l),
s as (select l_orderkey, col, sum(v) as footed, sum(v) + case when l_orderkey % 10 = 0 then 0.05 else 0 end as total from c group by l_orderkey, col)
select l_orderkey, col, cast(footed as double) as footed, cast(total as double) as total, cast(abs(total - footed) as double) as difference, total = footed as passed, case when total = footed then 'info' else 'warning' end as severity from s where total <> 0""")
def q47_table_footing(t):
    """Tables of an order's lines with a total row, some totals off by five cents, and a column of percentages."""
    shown = F.array(F.struct(F.lit("price").alias("col"), money("l_extendedprice").alias("v")), F.struct(F.lit("quantity").alias("col"), money("l_quantity").alias("v")))
    lines = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("row_no"), F.when(F.col("l_linenumber") == 7, "减：返还").otherwise("明细").alias("label"), F.explode(shown).alias("c")).select("l_orderkey", "row_no", "label", "c.*")
    sums = lines.groupBy("l_orderkey", "col").agg(F.sum(F.when(F.col("label") == "明细", F.col("v")).otherwise(-F.col("v"))).alias("v"))
    off = F.when(F.col("l_orderkey") % 10 == 0, F.lit("0.05").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    totals = sums.select("l_orderkey", F.lit(100).alias("row_no"), F.when(F.col("l_orderkey") % 3 == 0, "小 计").otherwise("合计").alias("label"), "col", (F.col("v") + off).alias("v"))
    cells = lines.unionByName(totals).withColumn("text", F.col("v").cast("string")).drop("v")
    rates = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("row_no"), F.lit("明细").alias("label"), F.lit("rate").alias("col"), F.lit("12%").alias("text"))
    return report.foot_tables(cells.unionByName(rates), "l_orderkey", "row_no", "col", "label", "text", "col")


@query("""
select case event_type when 'view' then 'A' when 'click' then 'B' when 'error' then 'C' end as pattern, case when event_type in ('view', 'click', 'error') then event_id % 13 <> 0 end as passed, count(*) as n from events group by all""")
def q48_cross_footing(t):
    kind, v, k = F.col("event_type"), money("value"), (F.col("event_id") % 10).cast("decimal(18,2)")
    off = F.when(F.col("event_id") % 13 == 0, F.lit("0.50").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    names = lambda *x: F.array(*[F.lit(n) for n in x])
    cells = lambda *x: F.array(*[c.cast("string") for c in x])
    headers = F.when(kind == "view", names("项目", "账面余额", "坏账准备", "账面价值")).when(kind == "click", names("项目", "期初数", "本期增加", "本期减少", "期末数")).when(kind == "error", names("原价", "累计折旧", "减值", "净值")).otherwise(names("甲", "乙"))
    row = F.when(kind == "view", cells(F.lit("x"), v, k, v - k + off)).when(kind == "click", cells(F.lit("x"), v, k, F.lit(1), v + k - 1 + off)).otherwise(cells(v, k, F.lit(1), v - k - 1 + off))
    rows = t("events").select(headers.alias("headers"), row.alias("cells"))
    return report.cross_foot_tables(rows, "headers", "cells").groupBy("pattern", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("""
with r as (select l_returnflag, cast(l_extendedprice as decimal(18,2)) as g, cast(l_discount as decimal(18,2)) as d, cast(l_tax as decimal(18,2)) as x from lineitem),
c as (select l_returnflag, case l_returnflag when 'A' then g - d + x when 'N' then g - d else g end as e, g - d + x as a from r)
select l_returnflag, abs(e - a) <= 0.01 as passed, count(*) as n from c group by all""")
def q49_annotated_footing(t):
    g, d, x = money("l_extendedprice"), money("l_discount"), money("l_tax")
    rows = t("lineitem").select("l_returnflag", F.array(*[c.cast("decimal(24,2)") for c in (g, d, x, g - d + x)]).alias("v"))
    notes = rows.sparkSession.sql("""select l_returnflag, operands, 3 as result_col from values
        ('A', array(named_struct('col', 0, 'op', '+'), named_struct('col', 1, 'op', '-'), named_struct('col', 2, 'op', '+'))),
        ('N', array(named_struct('col', 0, 'op', '+'), named_struct('col', 1, 'op', '-'))), ('R', array(named_struct('col', 0, 'op', '+'))) as a(l_returnflag, operands)""")
    return report.annotated_cross_foot(rows, notes, "l_returnflag", "v").groupBy("l_returnflag", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, sum(floor(l_quantity * 3 / 7) + l_linenumber ** 2 - (l_quantity % 5) / 4) as v, count(l_quantity / nullif(l_linenumber - 1, 0)) as n_divided from lineitem group by 1")
def q50_formula(t):
    value = lambda n: F.col(f"l_{n}").cast("double")
    rows = t("lineitem").select("l_returnflag", compile_formula("quantity * 3 // 7 + linenumber ** 2 - (quantity % 5) / 4", value).alias("v"), compile_formula("quantity / (linenumber - 1)", value).alias("d"))
    return rows.groupBy("l_returnflag").agg(F.sum("v").alias("v"), F.count("d").alias("n_divided"))


@query("""
with c as (select c_custkey as k, 'S' || c_custkey || case when c_custkey % 3 = 0 then '净额' else '' end as subject, case when c_custkey % 7 = 0 then null else cast(c_acctbal as decimal(18,2)) + 10 - case when c_custkey % 5 = 0 then 12 else 10 end end as note,
 case when c_custkey % 11 = 10 then null when c_custkey % 2 = 0 then cast(c_acctbal as decimal(18,2)) else cast(c_acctbal as decimal(18,2)) + 100 end as stated from customer),
r as (select subject, note, stated, stated is null or coalesce(abs(note - stated) <= 0.01, false) as passed from c)
select subject, cast(note as double) as note, cast(stated as double) as stated, passed, case when passed then 'info' when note is null then 'warning' else 'error' end as severity from r""")
def q51_note_tieout(t):
    k, v = F.col("c_custkey"), money("c_acctbal")
    notes = t("customer").select(
        words("S", k, F.when(k % 3 == 0, "净额").otherwise("")).alias("subject"), F.lit("a - b").alias("formula"),
        F.map_from_entries(F.filter(F.array(F.struct(F.lit("a"), (v + 10).cast("double")), F.struct(F.lit("b"), F.when(k % 7 != 0, F.when(k % 5 == 0, 12.0).otherwise(10.0)))), lambda x: x["col2"].isNotNull())).alias("values"),
    )
    both = t("customer").where("c_custkey % 11 <> 10")
    parent = both.select(words("S", k).alias("item"), F.lit("parent").alias("scope"), (v + 100).cast("double").alias("current"))
    whole = both.where("c_custkey % 2 = 0").select(words("S", k).alias("item"), F.lit("consolidated").alias("scope"), v.cast("double").alias("current"))
    return report.note_tie_out(notes, parent.unionByName(whole)).withColumn("note", F.round("note", 2))


@query("""
with c as (select l_orderkey, l_partkey, l_discount * 10 as c, abs(l_extendedprice - 50000) <= 2500 as near, l_returnflag = 'A' as hit from lineitem),
k as (select l_orderkey, l_partkey, round(case when near then least(0.95, c + 0.2) when hit then least(0.8, c + 0.1) else greatest(0.4, c - 0.3) end, 6) as corrected from c where c >= 0.5)
select l_orderkey, arg_max(l_partkey, (corrected, -l_partkey)) as l_partkey, max(corrected) as corrected from k where corrected >= 0.6 group by 1""")
def q52_candidate_tables(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", (F.col("l_discount") * 10).alias("c"), "l_extendedprice", F.lit(50000.0).alias("stated"), (F.col("l_returnflag") == "A").alias("hit"))
    return report.candidates(rows, "l_orderkey", "c", "l_extendedprice", "stated", "hit", "l_partkey")


@query("""
with s as (select user_id, count(distinct event_id // 40) as n_present, max(event_id // 40) - min(event_id // 40) + 1 - count(distinct event_id // 40) as n_missing from events group by 1)
select *, case when n_missing = 0 then 'passed' when n_missing <= least(20, floor(n_present * 0.1)) then 'info' else 'warning' end as verdict from s""")
def q53_page_continuity(t):
    return report.continuity(t("events").withColumn("page", F.floor(F.col("event_id") / 40)), "user_id", "page")


#: Wrong words among the syllables of the given texts, what stands for the right ones, and whole words that hold a wrong one.
TYPOS, WHOLE = {"oredat": "predate", "ndern": "modern", "thwh": "that", "chtkeit": "keit"}, ["anthwhon", "nderntionre", "schtkeiten"]


@query("""
with raw as (select doc_id, '<!-- SOURCE file="a" page=1 -->' || replace(text, chr(10), chr(10) || '<!-- SOURCE file="a" page=2 method=x -->') as raw from documents),
d as (select *, regexp_replace(regexp_replace(raw, '<!--.*?-->', '', 'gs'), '\\s+', '', 'g') as bare from raw),
w as (select * from (values ('oredat', 'predate', null, 'o\\s*r\\s*e\\s*d\\s*a\\s*t'), ('ndern', 'modern', 'nderntionre', 'n\\s*d\\s*e\\s*r\\s*n'), ('thwh', 'that', 'anthwhon', 't\\s*h\\s*w\\s*h'), ('chtkeit', 'keit', 'schtkeiten', 'c\\s*h\\s*t\\s*k\\s*e\\s*i\\s*t')) v(typo, suggestion, whole, spread)),
h as (select *, position(typo in bare) as p from d join w on contains(bare, typo) and not coalesce(contains(bare, whole), false))
select doc_id, typo, suggestion, substr(bare, greatest(p - 20, 1), p - greatest(p - 20, 1) + length(typo) + 20) as context,
 case when regexp_matches(raw, spread) then list_extract(regexp_extract_all(regexp_extract(raw, '(?s)^(.*?)' || spread, 1), '<!-- SOURCE[^>]*page=(\\d+)[^>]*-->', 1), -1) end as page from h""")
def q54_typo_scan(t):
    marked = F.concat(F.lit('<!-- SOURCE file="a" page=1 -->'), F.replace("text", F.lit("\n"), F.lit('\n<!-- SOURCE file="a" page=2 method=x -->')))
    return terms.typos(t("documents").select("doc_id", marked.alias("text")), "doc_id", "text", TYPOS, WHOLE)


@query("""
with f as (select case when l_returnflag = 'A' then 'typo' else 'grammar' end as kind, l_discount * 10 as confidence from lineitem)
select kind, case when kind = 'typo' and confidence >= 0.85 then 'error' else 'warning' end as severity, count(*) as n from f where kind = 'typo' and confidence >= 0.5 or confidence >= 0.85 group by all""")
def q55_confidence_bands(t):
    rows = t("lineitem").select(F.when(F.col("l_returnflag") == "A", "typo").otherwise("grammar").alias("kind"), (F.col("l_discount") * 10).alias("confidence"))
    return report.banded(rows).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""
with r as (select o_orderstatus, o_orderkey % 4 = 1 as needs_review, o_orderkey % 3 = 0 as passed, case when o_orderkey % 3 = 0 or o_orderkey % 4 = 0 then 'info' when o_orderkey % 3 = 1 then 'warning' else 'error' end as severity from orders),
s as (select o_orderstatus, needs_review, count(*) as n, count(*) filter (passed) as n_passed, count(*) filter (not passed and severity = 'error') as n_error, count(*) filter (not passed and severity = 'warning') as n_warning from r group by all)
select *, round(100.0::double * (n_error + n_warning) / n, 4) as issue_rate from s""")
def q56_review_summary(t):
    k = F.col("o_orderkey")
    results = t("orders").select(k.alias("result_id"), "o_orderstatus", (k % 3 == 0).alias("passed"), F.when(k % 3 == 0, "info").when(k % 3 == 1, "warning").otherwise("error").alias("severity"))
    decisions = t("orders").where("o_orderkey % 4 < 3").select(k.alias("result_id"), F.when(k % 4 == 0, "downgrade").when(k % 4 == 1, "needs_review").otherwise("confirm").alias("decision"))
    return report.summary(report.reviewed(results, decisions), ["o_orderstatus", "needs_review"])


@query("""
select case when text is null or contains(text, 'ionsh') then '/' when contains(text, 'oredat') or contains(text, 'schb') then '不符合' when regexp_matches(text, 'tion.*the') then '建议项' else '符合' end as verdict, count(*) as n from documents group by 1""")
def q57_compliance(t):
    return t("documents").groupBy(report.compliance(F.col("text"), ["ionsh"], ["oredat", "schb"], "tion.*the").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with w as (select doc_id, unnest(list_distinct(string_split_regex(text, '\\s+'))) as subject from documents)
select doc_id, subject from w where subject in (select string_split(text, ' ')[2] from benchmark)""")
def q58_subject_tables(t):
    return report.subject_tables(t("documents"), t("benchmark").select(F.split("text", " ")[1].alias("subject")), "doc_id", "text", "subject")


@query("select l_partkey, l_orderkey, l_discount * 10 as score, cast(row_number() over (partition by l_partkey order by l_discount desc, l_orderkey) as int) as rank from lineitem where l_discount * 10 >= 0.5 qualify rank <= 2")
def q59_top_for_role(t):
    return report.top_for_role(t("lineitem").select("l_partkey", "l_orderkey", (F.col("l_discount") * 10).alias("score")), "l_partkey", "score", "l_orderkey")


SPOKEN = "with s as (select conv_id, turn, trim(regexp_replace(trim(text), '<[^>]+>', '', 'g')) as text from conversations), k as (select *, lag(text) over (partition by conv_id order by turn) as b from s where text <> '')"


@query(SPOKEN + " select conv_id, turn, md5(text) as digest from k where b is null or b <> text")
def q60_subtitle_lines(t):
    return documents.subtitle_lines(t("conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("text").alias("digest"))


@query()
def q61_subtitle_paragraphs(t):
    return documents.paragraphs(documents.subtitle_lines(t("conversations"), "conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("with s as (select page_id, unnest(string_split(html, '<p>')) as s, unnest(range(0, len(string_split(html, '<p>')))) as n from pages) select page_id, cast(n as int) as segment_no, md5(s) as digest from s where length(s) > 50")
def q62_segments(t):
    return documents.segments(t("pages"), "page_id", "html", "<p>").select("page_id", "segment_no", F.md5("segment").alias("digest"))


@query("select item_id, cast(unnest([0, 1, 2]) as int) as part_no, unnest(['总则', '第' || item_id || '条' || text, '第二章' || text]) as part from benchmark")
def q63_statute_parts(t):
    b = t("benchmark").select("item_id", words("总则第", F.col("item_id"), "条", F.col("text"), "第二章", F.col("text")).alias("body"))
    return documents.statute_parts(b, "item_id", "body")


@query("""
with s as (select page_id, html, regexp_extract_all(html, '(href="[^"]*")', 1) as l from pages)
select page_id, len(l) as n_links, len(list_distinct(l)) as n_distinct_links, len(regexp_extract_all(html, '<h1')) as n_primary, len(regexp_extract_all(html, 'nav|ad ')) as n_secondary from s""")
def q64_source_counts(t):
    return documents.source_counts(t("pages"), "page_id", "html", 'href="[^"]*"', "<h1", "nav|ad ")


@query("select cast((c_custkey % 2 = 0)::int + (c_custkey % 3 = 0)::int + 1 as int) as completeness, count(*) as n from customer group by 1")
def q65_completeness(t):
    k = F.col("c_custkey")
    rows = t("customer").select(F.when(k % 2 == 0, F.col("c_name")).alias("a"), F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise(" ").alias("b"), F.col("c_nationkey").alias("c"))
    return documents.filled(rows, ["a", "b", "c"]).groupBy("completeness").agg(F.count(F.lit(1)).alias("n"))


@query("""
select cast(c_custkey as varchar) as c_custkey, c_mktsegment || ', ' || c_nationkey as list, case when c_custkey % 3 = 0 then '是' when c_custkey % 3 = 1 then '否' else '' end as flag, case when c_custkey % 2 = 0 then c_name else '' end as name from customer""")
def q66_export_cells(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k, F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("list"), F.when(k % 3 < 2, k % 3 == 0).alias("flag"), F.when(k % 2 == 0, F.col("c_name")).alias("name"))
    return tables.cell_text(rows)


@query("""
with c as (select item_id, list_concat(string_split(replace(text, 'th', 't|h'), ' '), ['', '', '', '', ''])[1:5] as c from benchmark)
select item_id, '| ' || array_to_string([replace(replace(x, '|', '\\|'), chr(10), ' ') for x in c], ' | ') || ' |' as line from c""")
def q67_markdown_rows(t):
    return t("benchmark").select("item_id", tables.markdown_row(F.split(F.replace("text", F.lit("th"), F.lit("t|h")), " "), 5).alias("line"))


@query("""
with n as (select distinct substr('the ' || p_name, 1 + cast(length(p_type) % 5 as int)) as name from part), r as (select p_name as title, min(p_partkey) as p_partkey from part group by 1),
m as (select name, title, p_partkey from n join r on (contains(name, title) and length(title) * 2 > length(name)) or (contains(title, name) and length(name) * 2 > length(title)) where length(name) >= 4 and length(title) >= 4)
select name, arg_min(title, (abs(length(title) - length(name)), p_partkey)) as title, arg_min(p_partkey, (abs(length(title) - length(name)), p_partkey)) as p_partkey from m group by 1""")
def q68_contained_titles(t):
    names = t("part").select(F.expr("substring(concat('the ', p_name), 1 + length(p_type) % 5)").alias("name"))
    records = t("part").groupBy(F.col("p_name").alias("record")).agg(F.min("p_partkey").alias("p_partkey"))
    return matching.contained_titles(names, records, "name", "record", "p_partkey")


@query("select doc_id, source from documents where contains(text, 'tion') and contains(text, 'sch')")
def q69_all_terms(t):
    return matching.all_terms(t("documents"), "text", "tion  sch").select("doc_id", "source")


@query("select o_orderkey, o_orderdate from orders where strftime(o_orderdate, '%m-%d') = '12-31'")
def q70_year_ends(t):
    return matching.in_period(t("orders"), "o_orderdate", annual=True).select("o_orderkey", "o_orderdate")


@query("""
with c as (select p_name as name, max(p_partkey) as k from part where p_size < 10 group by 1), b as (select p_name as name, min(p_partkey) as k from part group by 1)
select name, k, true as custom from c union all select name, k, false from b where name not in (select name from c)""")
def q71_overriding(t):
    p = t("part").withColumn("name", F.col("p_name"))
    return matching.overriding(p.where("p_size < 10").groupBy("name").agg(F.max("p_partkey").alias("k")), p.groupBy("name").agg(F.min("p_partkey").alias("k")), "name")


@query("""
with a as (select o_custkey, o_orderkey, o_totalprice, o_orderkey % 10 as second, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders)
select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by second desc, o_orderkey) as int) as rank from a where k <= 9 qualify rank <= 3""")
def q72_rerank(t):
    rows = t("orders").withColumn("second", F.col("o_orderkey") % 10)
    return matching.rerank(rows, "o_custkey", "o_orderkey", "o_totalprice", "second", 3).select("o_custkey", "o_orderkey", "rank")


@query("""
with n as (select user_id, event_id, lead(event_id) over (partition by user_id order by event_id) as nx from events)
select user_id, event_id as src, nx as dst from n where event_id % 3 = 0 and nx is not null union all select user_id, event_id, event_id + 1 from n where event_id % 3 = 1 union all select user_id, event_id, event_id + 2 from n where event_id % 3 = 1""")
def q73_next_edges(t):
    k = F.col("event_id")
    stated = F.when(k % 3 == 1, F.array(k + 1, k + 2)).when(k % 3 == 2, F.array().cast("array<bigint>"))
    return graph.next_edges(t("events").withColumn("next_steps", stated), "user_id", "event_id", "event_id", "next_steps")


@query("""
with h as (select l_suppkey, l_linenumber, max(cast(l_quantity as bigint)) as row_height from lineitem group by all)
select *, cast(coalesce(sum(row_height + 20) over (partition by l_suppkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) as bigint) as y from h""")
def q74_row_offsets(t):
    return graph.row_offsets(t("lineitem").withColumn("h", F.col("l_quantity").cast("long")), "l_suppkey", "l_linenumber", "h", 20)


@query("select depth, count(*) as n from (select 0 as depth from region union all select 1 from nation union all select 2 from customer where c_custkey % 90 >= 50) group by 1")
def q75_penetration(t):
    up = t("nation").select(words("r", F.col("n_regionkey")).alias("parent"), words("n", F.col("n_nationkey")).alias("child"), F.lit("60%").alias("ratio"))
    down = t("customer").select(words("n", F.col("c_nationkey")).alias("parent"), words("c", F.col("c_custkey")).alias("child"), words(F.col("c_custkey") % 90, "%").alias("ratio"))
    return graph.penetrate(up.unionByName(down), t("region").select(words("r", F.col("r_regionkey")).alias("node"))).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


LINKED = "select entity, dimension, value, min(entity) over (partition by dimension, value) as class_id, count(*) over (partition by dimension, value) - 1 as n_links, level from e qualify n_links > 0"


@query("""
with c as (select c_custkey as entity, c_custkey // 2 as a, c_custkey // 3 as b, c_custkey // 5 as w, c_custkey // 4 as s, c_nationkey as n from customer),
e as (select entity, 'phone' as dimension, '139' || lpad(a::varchar, 8, '0') as value, 3 as level from c union all select entity, 'email', 'u' || b || '@c' || n || '.example', 3 from c union all select entity, 'email_domain', 'c' || n || '.example', 3 from c
 union all select entity, 'same_building', '北京海淀区中关村大街' || s || '号', 2 from c union all select entity, 'website', 'h' || w || '.example', 2 from c) """ + LINKED)
def q76_contact_links(t):
    k = F.col("c_custkey")
    part = lambda n: F.floor(k / n)
    companies = t("customer").select(
        k, words("+86139", F.lpad(part(2).cast("string"), 8, "0"), "；").alias("phone"), words("U", part(3), "@C", F.col("c_nationkey"), ".Example").alias("email"),
        words("北京市 海淀区中关村大街", part(4), "号", k, "室").alias("address"), words("http://www.h", part(5), ".example/x").alias("website"),
    )
    return related.linked(related.contacts(companies, "c_custkey"))


@query("with e as (select distinct l_orderkey as entity, 'person' as dimension, 'P' || l_suppkey as value, 2 as level from lineitem where l_suppkey not in (select s_suppkey from supplier where s_nationkey = 3)) " + LINKED)
def q77_shared_people(t):
    marks = t("lineitem").select(F.col("l_orderkey").alias("entity"), F.lit("person").alias("dimension"), words("P", F.col("l_suppkey")).alias("value"))
    public = t("supplier").where("s_nationkey = 3").select(words("P", F.col("s_suppkey")).alias("value"))
    return related.linked(related.without_excluded(marks, public))


@query("""
with l as (select c_custkey as entity, c_nationkey || c_mktsegment as value from customer where c_custkey % 2 = 0), r as (select c_custkey as other, c_nationkey || c_mktsegment as value from customer where c_custkey % 3 = 0)
select entity, value, case when min(other) <> entity then min(other) else max(other) end as class_id, count(*) filter (other <> entity) as n_links from l join r using (value) group by entity, value having n_links > 0""")
def q78_former_names(t):
    rows = t("customer").select(F.col("c_custkey").alias("entity"), words(F.col("c_nationkey"), F.col("c_mktsegment")).alias("value"))
    return related.crossed(rows.where("entity % 2 = 0"), rows.where("entity % 3 = 0"), "former_name", related.MEDIUM).drop("dimension", "level")


@query("""
with f as (select c_custkey, list_filter([case when 1990 + c_custkey % 40 >= 2018 then 'young' end, case when c_custkey % 300 < 100 then 'small_capital' end, case when c_custkey % 20 < 5 then 'few_insured' end,
 case when c_custkey % 6 = 0 then 'residential' end, case when least(c_custkey % 15, length(c_name)) < 10 then 'no_scope' end], lambda x: x is not null) as f from customer)
select c_custkey, array_to_string(f, '|') as flags, cast(len(f) as int) as n_flags, case when len(f) >= 2 then 2 when len(f) = 1 then 1 end as level from f""")
def q79_profile_flags(t):
    k = F.col("c_custkey")
    companies = t("customer").select(
        k, words(1990 + k % 40, "-05").alias("founded"), words(k % 300, "万人民币").alias("capital"), words(k % 20, "人").alias("insured"), F.when(k % 6 == 0, "幸福小区3栋").otherwise("大街1号").alias("address"),
        F.expr("substring(c_name, 1, int(c_custkey % 15))").alias("scope"),
    )
    return related.profile(companies).select("c_custkey", F.array_join("flags", "|").alias("flags"), "n_flags", "level")


@query("""
with p as (select distinct l_suppkey as a, l_partkey as b from lineitem)
select case when a % 4 = 0 and b % 4 = 0 and b <= (select max(s_suppkey) from supplier) then 'in_group' when a % 4 = 0 or b % 4 = 0 and b <= (select max(s_suppkey) from supplier) then 'target_counterparty' else 'hidden' end as relation, count(*) as n from p group by 1""")
def q80_relation_types(t):
    trades = t("lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    targets = t("supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("name"))
    return related.relation_type(trades, targets, "a", "b", "name").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""
with e as (select distinct l_suppkey as p, l_partkey as c from lineitem), k as (select s_suppkey as k from supplier union select p_partkey from part)
select 'C' || p as parent, count(*) as n from e where c in (select k from k) and p in (select k from k) group by 1""")
def q81_investments(t):
    """Companies are suppliers and parts, whole keys, so that no trade of either is left out."""
    edges = t("lineitem").select(words("C", F.col("l_suppkey")).alias("parent"), words("C", F.col("l_partkey")).alias("child"))
    known = t("supplier").select(words("C", F.col("s_suppkey")).alias("name")).unionByName(t("part").select(words("C", F.col("p_partkey")).alias("name")))
    return related.investments(edges, known).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


@query("select lang as project, count(*) as n_chunks, count(distinct source) as n_sources from documents group by 1")
def q82_collections(t):
    return store.counts(t("documents").withColumnRenamed("lang", "project"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all")
def q83_windowed_counts(t):
    return ingest.windowed(t("events"), "ts", "1 hour", "event_type")


@query("""
with b as (select p_partkey, p_partkey % 6 as k from part)
select p_partkey, 0 as item_col, case k when 0 then 2 when 1 then 2 when 2 then 1 when 3 then 3 when 4 then 1 else 1 end as current_col, case k when 0 then 1 when 1 then 1 when 2 then 2 when 3 then 1 when 4 then 1 else 2 end as prior_col from b""")
def q84_column_roles(t):
    """Opening before closing, years in either order, one header told, and none told: digits decide, the left of equals first."""
    heads = [("项目", "期初余额", "期末余额", "x"), ("项目", "2023年", "2024年", "x"), ("项目", "本期金额", "上期金额", "x"), ("项目", "年初数", "附注", "甲"), ("项目", "上年", "甲", "乙"), ("甲", "乙", "丙", "丁")]
    digits = [(0.1, 0.9, 0.8, 0.1), (0.1, 0.9, 0.8, 0.1), (0.1, 0.2, 0.8, 0.9), (0.9, 0.1, 0.2, 0.9), (0.1, 0.9, 0.9, 0.1), (0.9, 0.5, 0.5, 0.2)]
    cases = [F.array(*[F.struct(F.lit(i).alias("column"), F.lit(h).alias("header"), F.lit(d).alias("share")) for i, (h, d) in enumerate(zip(hs, ds))]) for hs, ds in zip(heads, digits)]
    rows = t("part").select("p_partkey", F.explode(F.get(F.array(*cases), (F.col("p_partkey") % 6).cast("int"))).alias("c")).select("p_partkey", "c.*")
    return statements.column_roles(rows, "p_partkey", "column", "header", "share")


@query("""
with c as (select c_nationkey, c_custkey as current, cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as rank from customer where c_custkey % 2 = 0), p as (select c_nationkey, c_custkey as prior, cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as rank from customer where c_custkey % 2 = 1)
select c_nationkey, rank, current, prior from c join p using (c_nationkey, rank)""")
def q85_pair_by_rank(t):
    c = t("customer")
    return statements.pair_by_rank(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), "c_nationkey", "c_custkey")


@query("select p_partkey, p_brand || ' old widget ring' like '%' || array_to_string(string_split(p_name, ''), '%') || '%' as found from part")
def q86_subsequence(t):
    return t("part").select("p_partkey", is_subsequence(F.col("p_name"), words(F.col("p_brand"), " old widget ring")).alias("found"))


@query("select o_orderkey as id from orders where o_orderkey % 3 = 0 union all select o_orderkey from orders where o_orderkey % 3 <> 0 and o_orderkey % 2 = 0")
def q87_upsert(t):
    k = t("orders").select(F.col("o_orderkey").alias("id"))
    return store.upsert(k.where("id % 2 = 0"), k.where("id % 3 = 0"))


@query("""
with l as (select l_orderkey as k, case when l_linenumber = 7 then -1 else 1 end as sign, cast(l_extendedprice as decimal(18,2)) as p, cast(l_quantity as decimal(18,2)) as q from lineitem),
s as (select k, 1 as col, sum(sign * p) as footed from l group by k union all select k, 2, sum(sign * q) from l where k % 5 = 0 group by k),
f as (select k, col, footed, footed + case when k % 10 = 0 then 0.05 else 0 end as total from s where k % 4 <> 1)
select k, col, cast(footed as double) as footed, cast(total as double) as total, cast(abs(total - footed) as double) as difference, total = footed as passed, case when total = footed then 'info' else 'warning' end as severity from f where total <> 0""")
def q135_matrix_footing(t):
    """Tables of an order's lines under no, one or two further header rows; a row 减： is taken off, 减值损失 is not; some totals are 0.00."""
    k, texts = F.col("k"), lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    lines = t("lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("n"), money("l_extendedprice").alias("p"), money("l_quantity").alias("q")).alias("line"))
    label = lambda n: F.when(n == 7, "减：返还").when(n == 3, "减值损失").otherwise("明细")
    written = lambda x: texts(label(x["n"]), x["p"].cast("string"), x["q"].cast("string"))
    signed = lambda c: F.when(F.col("line.n") == 7, -F.col(f"line.{c}")).otherwise(F.col(f"line.{c}"))
    off = F.when(F.col("k") % 10 == 0, F.lit("0.05").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    shown = lambda c: F.when(k % 4 == 1, "0.00").otherwise((c + off).cast("string"))
    # Lines are shuffled as numbers, over all partitions, as their tables take far more time than their bytes tell, and written afterwards.
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    sums = lines.groupBy("k").agg(F.transform(F.sort_array(F.collect_list("line")), written).alias("lines"), F.sum(signed("p")).alias("p"), F.sum(signed("q")).alias("q"))
    last = F.when(k % 5 == 0, "数量").otherwise("占比")
    headers = F.when(k % 3 == 0, texts("项目", "金额", last)).when(k % 3 == 1, texts("项目", "本年", "本年")).otherwise(texts("项目", "2024", "2024"))
    above = F.when(k % 3 == 1, F.array(texts("项目", "金额", last))).when(k % 3 == 2, F.array(texts("", "本年", "本年"), texts("类别", "金额", last)))
    rows = F.concat(F.coalesce(above, F.array().cast("array<array<string>>")), "lines", F.array(texts("合计", shown(F.col("p")), shown(F.col("q")))))
    return report.foot_matrices(sums.select("k", headers.alias("headers"), rows.alias("rows")), "k", "headers", "rows")


@query("""
with l as (select l_orderkey as k, case when l_linenumber = 4 then -1 else 1 end as sign, cast(l_extendedprice as decimal(18,2)) as p, cast(l_quantity as decimal(18,2)) as q from lineitem where l_linenumber <> 5),
s as (select k, 1 as col, sum(sign * p) as footed from l group by k union all select k, 2, sum(sign * q) from l group by k),
f as (select k, 100 as row_no, col, footed, footed as total from s union all select k, 50, col, footed, footed + case when k % 10 = 0 then 0.05 else 0 end from s where k % 4 <> 1)
select k, row_no, col, cast(footed as double) as footed, cast(total as double) as total, cast(abs(total - footed) as double) as difference, total = footed as passed, case when total = footed then 'info' else 'warning' end as severity from f where total <> 0""")
def q136_annotated_totals(t):
    """An order's lines as annotated rows: line 4 is taken off, line 5 is a part of another, rows 50 and 100 hold totals."""
    k, n = F.col("k"), F.col("row_no")
    sign = F.when(n == 4, -1).when(n == 5, 0).otherwise(1)
    lines = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("row_no"), money("l_extendedprice").alias("p"), money("l_quantity").alias("q"))
    cells_of = lambda rows, text: rows.select("k", "row_no", F.explode(F.array(*[F.struct(F.lit(i).alias("col"), text(F.col(v)).alias("text")) for i, v in ((1, "p"), (2, "q"), (3, "p"))])).alias("c")).select("k", "row_no", "c.*")
    off = F.when((k % 10 == 0) & (n == 50), F.lit("0.05").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    sums = lines.groupBy("k").agg(F.sum(F.col("p") * sign).alias("p"), F.sum(F.col("q") * sign).alias("q"))
    totals = sums.withColumn("row_no", F.explode(F.array(F.lit(50), F.lit(100))))
    shown = lambda v: F.when((k % 4 == 1) & (n == 50), "—").otherwise((v + off).cast("string"))
    cells = cells_of(lines, lambda v: v.cast("string")).unionByName(cells_of(totals, shown))
    # Notes are made of a line's and an order's key, not of all their cells.
    orders = lines.select("k").distinct()
    kind = F.when(n == 50, "小计").when(n == 100, "total").otherwise("detail")
    noted = lines.select("k", "row_no").distinct().unionByName(orders.select("k", F.explode(F.array(F.lit(50), F.lit(100))).alias("row_no")))
    row_notes = noted.select("k", "row_no", kind.alias("kind"), F.when(n == 4, "-").otherwise("+").alias("op"), (n == 5).alias("is_subitem"))
    kinds = F.create_map(F.lit(1), F.lit("amount"), F.lit(2), F.lit("Amount_in_units"), F.lit(3), F.lit("percentage"))
    column_notes = orders.select("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("col")).withColumn("kind", kinds[F.col("col")])
    return report.annotated_foot(cells, row_notes, column_notes, "k", "row_no", "col", "text")
