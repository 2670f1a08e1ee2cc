"""Queries of the choice of files, places in documents and nested payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.plans.registry import query
from tallystone.sources import files, markup

EXT = ["docx", "pdf", "doc", "xlsx"]


@query(f"""
with f as (select o_orderkey, '/d' || o_custkey % 7 || '/Report' || o_orderkey // 3 || '.' || {EXT}[1 + o_orderkey % 4] as path from orders),
r as (select *, row_number() over (partition by regexp_extract(path, '^(.*/)', 1), lower(regexp_extract(path, '([^/.]+)[.]', 1)) order by case when path like '%.docx' then 1 when path like '%.pdf' then 2 else 3 end, path) as k from f where path not like '%.xlsx')
select path, count(*) as n from r where k = 1 group by 1""")
def q106_one_file_per_name(t):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/d"), (F.col("o_custkey") % 7).cast("string"), F.lit("/Report"), F.floor(k / 3).cast("string"), F.lit("."), F.get(F.array(*[F.lit(e) for e in EXT]), (k % 4).cast("int")))
    return files.one_per_name(t("orders").select(path.alias("path")), "path").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with f as (select o_orderkey as k, {EXT}[1 + o_orderkey % 4] as e, o_orderkey % 3 = 0 as short, o_orderkey % 5 as shapes, o_orderkey % 2 as tables from orders)
select k, case when e = 'pdf' then case when short then 'ocr' else 'pdf_text' end when e = 'docx' then case when shapes >= 3 or tables = 0 and shapes > 0 then 'ocr' else 'docx_xml' end else 'skipped' end as route,
 case when e = 'xlsx' then case when k % 3 = 1 then 'statements' else 'notes' end end as role from f""")
def q107_file_routes(t):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("A.b/x."), F.get(F.array(*[F.lit(e) for e in EXT]), (k % 4).cast("int")))
    page = F.when(k % 3 == 0, F.lit("  " + "x" * 50 + " ")).otherwise("x" * 51)
    sheets = F.array(F.lit("封面"), F.when(k % 3 == 1, "合并利润表").otherwise("附注"))
    return t("orders").select(k.alias("k"), files.route(path, page, k % 5, k % 2).alias("route"), files.workbook_role(path, sheets).alias("role"))


@query("select conv_id, avg(length(trim(coalesce(text, '')))) < 50 as scanned from conversations group by 1")
def q108_scanned_documents(t):
    """Conversations as documents, a page a turn, whole texts."""
    return files.scanned_documents(t("conversations"), "conv_id", "text")


@query("""
with c as (select user_id, event_id, event_id % 90 as x0, event_id % 90 + 2 as x1, event_id % 61 as top, event_id % 61 + 4 as bottom, substr(event_type, 1, 1) as text from events),
o as (select * from c where not (user_id % 2 = 0 and x0 + 1 between 10 and 40 and top + 2 between 5 and 30 or user_id % 3 = 0 and x0 + 1 between 50 and 60 and top + 2 between 0 and 60))
select user_id, cast(round_even(top / 3.0, 0) as bigint) as line, string_agg(text, '' order by x0, text) as text from o group by all""")
def q109_text_outside_tables(t):
    k = F.col("event_id")
    chars = t("events").select("user_id", (k % 90).alias("x0"), (k % 90 + 2).alias("x1"), (k % 61).alias("top"), (k % 61 + 4).alias("bottom"), F.substring("event_type", 1, 1).alias("text"))
    users = t("events").select("user_id").distinct()
    box = lambda x0, top, x1, bottom: [F.lit(v).alias(n) for v, n in ((x0, "x0"), (top, "top"), (x1, "x1"), (bottom, "bottom"))]
    boxes = users.where("user_id % 2 = 0").select("user_id", *box(10, 5, 40, 30)).unionByName(users.where("user_id % 3 = 0").select("user_id", *box(50, 0, 60, 60)))
    return files.text_outside(chars, boxes, "user_id")


@query("""
select o_custkey as k, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as n, unnest(['', '概况', '附注', '附注五-1 货币资金', '附注五-1 货币资金', '附注五-2 应收账款' || o_custkey, '附注五-2 应收账款' || o_custkey, '其他' || o_custkey]) as chapter from (select distinct o_custkey from orders)""")
def q110_chapters(t):
    k = F.col("o_custkey")
    part = lambda n, text, style: F.struct(F.lit(n).alias("n"), (text if not isinstance(text, str) else F.lit(text)).alias("text"), F.lit(style).alias("style"))
    parts = F.array(
        part(0, "封面。", "Normal"), part(1, "概况", "Heading 1"), part(2, "五、附注", "Normal"), part(3, "货币资金", "Normal"), part(4, "注：说明", "Normal"), part(5, F.concat(F.lit("2、应收账款"), k.cast("string")), "Normal"),
        part(6, "", "Normal"), part(7, F.concat(F.lit("其他"), k.cast("string")), "标题 1"),
    )
    rows = t("orders").select("o_custkey").distinct().select(k.alias("k"), F.explode(parts).alias("p"))
    return files.chapters(rows.select("k", "p.*"), "k", "n", "text", "style").select("k", "n", "chapter")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'own.pdf' when o_orderkey % 3 = 0 then 'b/Balance.pdf' when o_orderkey % 3 = 1 then 'c/附注.docx' else 'a/cover.pdf' end as source_file from orders")
def q111_result_sources(t):
    k = F.col("o_orderkey")
    results = t("orders").select(k, F.when(k % 3 == 0, "报表间").when(k % 3 == 1, "竖加").otherwise("文本").alias("check_type"), F.when(k % 5 == 0, "own.pdf").otherwise("").alias("source_file"))
    sources = results.sparkSession.createDataFrame([(0, "a/cover.pdf"), (1, "b/balance.xlsx"), (2, "b/Balance.pdf"), (3, "c/附注.docx")], "n int, path string")
    return files.with_source(results, sources, "path", "n").select("o_orderkey", "source_file")


@query("""
select c_custkey, 'N' || c_custkey as name, '12%' as ratio, cast(c_custkey as varchar) as id from customer where c_custkey % 5 < 4""")
def q112_invested(t):
    k = F.col("c_custkey")
    entry = lambda n, r, i: F.concat(F.lit(f'{{"{n}": "N'), k.cast("string"), F.lit(f'", "{r}": "12%", "{i}": "'), k.cast("string"), F.lit('"}'))
    payload = F.when(k % 5 == 0, F.concat(F.lit('{"invests": ['), entry("name", "ratio", "id"), F.lit("]}"))).when(k % 5 == 1, F.concat(F.lit('{"invests": {"children": ['), entry("investName", "investRatio", "orgId"), F.lit("]}}"))) \
        .when(k % 5 == 2, F.concat(F.lit('{"invests": {"list": ['), entry("company", "percent", "orgid"), F.lit("]}}"))).when(k % 5 == 3, F.concat(F.lit('{"invests": null, "investList": ['), entry("name", "ratio", "id"), F.lit("]}"))).otherwise("{}")
    return t("customer").select("c_custkey", F.explode(files.invested(payload)).alias("i")).select("c_custkey", "i.*")


@query("select p_partkey, 'a' || p_partkey || '|b' as codes, 'context ' || p_partkey as contexts from part")
def q113_nested_payloads(t):
    k = F.col("p_partkey").cast("string")
    classes = F.concat(F.lit('[{"children": [{"second_dimension_code": "a'), k, F.lit('"}, {"second_dimension_code": ""}, {"other": 1}]}, {"children": null}, {"children": [{"second_dimension_code": "b"}]}]'))
    message = F.concat(F.lit('{"1": [{"context": " context '), k, F.lit('"}, {"context": "abcde"}], "x": [{"context": "not numeric"}], "2": "text"}'))
    return t("part").select("p_partkey", F.array_join(files.dimension_codes(classes), "|").alias("codes"), F.array_join(files.nested_contexts(message), "|").alias("contexts"))


@query("""
select p_partkey, cast(unnest([0, 0, 1]) as bigint) as table_no, cast(unnest([0, 1, 0]) as bigint) as row_no, unnest(['a/' || p_partkey, 'x y/z', 'last/' || p_size]) as cells from part""")
def q114_markdown_tables(t):
    text = F.concat(F.lit("intro\n| a | "), F.col("p_partkey").cast("string"), F.lit(" |\n|---|:-:|\n|x y|  z|\n\ntext\n| last | "), F.col("p_size").cast("string"), F.lit(" |\n"))
    found = markup.markdown_tables(t("part").select("p_partkey", text.alias("t")), "p_partkey", "t")
    return found.select("p_partkey", F.col("table_no").cast("long").alias("table_no"), F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "/").alias("cells"))


@query("""
select p_partkey, cast(unnest([0, 0, 1]) as bigint) as table_no, cast(unnest([0, 1, 0]) as bigint) as row_no, unnest(['a/' || p_partkey, 'x y/z', 'last/' || p_size]) as cells from part""")
def q115_html_tables(t):
    text = F.concat(F.lit("<p>i</p><table><tr><th>a</th><th class='n'> <b>"), F.col("p_partkey").cast("string"), F.lit("</b> </th></tr>\n<tr><td>x y</td><td>z</td></tr></table>t<TABLE><tr><td>last</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></TABLE>"))
    found = markup.html_tables(t("part").select("p_partkey", text.alias("t")), "p_partkey", "t")
    return found.select("p_partkey", F.col("table_no").cast("long").alias("table_no"), F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "/").alias("cells"))
