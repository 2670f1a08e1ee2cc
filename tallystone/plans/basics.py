"""Queries of the smaller functions: identities, names, numbers, picks and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import numbers, text
from tallystone.operators import audit, documents, matching, related, report, retrieval, statements
from tallystone.plans.registry import query
from tallystone.sinks import tables

#: Items of a statement by amounts a, b, c of an order, with R2 off by one for every fifth and R7 without tax for every third.
IDENTITY_ITEMS = [
    ("流动资产合计", "a"), ("非流动资产合计", "b"), ("资产总计", "a + b"), ("流动负债合计", "a - c"), ("非流动负债合计", "c"), ("负债合计", "a + case when k % 5 = 0 then 1 else 0 end"), ("所有者权益合计", "b"),
    ("负债和所有者权益总计", "a + b"), ("营业利润", "a"), ("营业外收入", "b"), ("营业外支出", "c"), ("利润总额", "a + b - c"), ("所得税费用", "case when k % 3 = 0 then null else c end"), ("净利润", "a + b - c - c"),
    ("经营活动产生的现金流量净额", "a"), ("投资活动产生的现金流量净额", "b"), ("筹资活动产生的现金流量净额", "c"), ("汇率变动对现金的影响", "c"), ("现金及现金等价物净增加额", "a + b + c + case when k % 2 = 0 then c else 0 end"),
    ("期初现金及现金等价物余额", "c"), ("期末现金及现金等价物余额", "a + b + c + c"),
]


@query("""
with v as (select o_orderkey as k from orders), r as (select k, unnest(['R1', 'R2', 'R3', 'R4', 'R6', 'R7', 'R8', 'R9']) as rule_id from v)
select rule_id, case rule_id when 'R2' then k % 5 <> 0 when 'R3' then k % 5 <> 0 when 'R7' then k % 3 <> 0 when 'R9' then k % 2 <> 0 else true end as passed,
 case when case rule_id when 'R2' then k % 5 <> 0 when 'R3' then k % 5 <> 0 when 'R7' then k % 3 <> 0 when 'R9' then k % 2 <> 0 else true end then 'info' when rule_id = 'R7' then 'warning' else 'error' end as severity, count(*) as n from r group by all""")
def q116_statement_identities(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(k.alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("a"), (F.col("o_custkey") + 1).cast("decimal(18,2)").alias("b"), (k % 90 + 2).cast("decimal(18,2)").alias("c"))
    items = F.array(*[F.struct(F.lit(n).alias("item"), F.expr(e).cast("decimal(24,4)").alias("current")) for n, e in IDENTITY_ITEMS])
    found = audit.identities(rows.select(F.col("k").alias("stmt"), F.explode(items).alias("i")).select("stmt", "i.*"))
    return found.groupBy("rule_id", "passed", "severity").agg(F.count(F.lit(1)).alias("n"))


#: Items as printed: numbers with other marks, 其中 and 减 without a colon, and names that lose their first letter.
PRINTED = ["一．货币　资金", "1）应收 票据", "其中应收账款（净）", "（三）减营业成本", "减值准备", "一年内到期"]


@query("""
select p_partkey, case p_partkey % 6 when 0 then '货币资金' when 1 then '应收票据' when 2 then '应收账款' when 3 then '营业成本' when 4 then '值准备' else '年内到期' end as item, case when p_partkey % 3 = 0 then '所有者权益合计' when p_partkey % 3 = 1 then '本年年末余额' else '存货' end as canonical, case when p_partkey % 2 = 0 then 'cash' else '应收' end as named, '中文' || p_partkey || '合计 a b' as joined, '法' || p_partkey as title, p_brand || '_x_' || p_partkey || '.docx' as file from part""")
def q117_clean_names(t):
    k = F.col("p_partkey").cast("string")
    rows = t("part").select(
        "p_partkey", statements.clean_item(F.concat(F.lit("（一）其中: "), F.lit("货币资金"), k, F.lit("（注）"))).alias("__x"), F.when(F.col("p_partkey") % 2 == 0, "货币").otherwise("应收").alias("named"),
        text.join_broken_cjk(F.concat(F.lit("中 文"), k, F.lit("合 计 a b"))).alias("joined"), text.clean_title(F.concat(F.lit("《<em class='x'>法</em>"), k, F.lit("》 "))).alias("title"), text.safe_filename(F.col("p_brand"), F.lit("x"), k, extension="docx").alias("file"),
        statements.clean_item(F.get(F.array(*[F.lit(n) for n in PRINTED]), (F.col("p_partkey") % 6).cast("int"))).alias("item"),
        statements.canonical_name(F.when(F.col("p_partkey") % 3 == 0, "股东权益合计").when(F.col("p_partkey") % 3 == 1, "期末余额").otherwise("存货")).alias("canonical"),
    )
    aliases = rows.sparkSession.createDataFrame([("货币", "cash"), ("现金", "cash")], "alias string, name string")
    return statements.canonical(rows.drop("__x"), aliases, "named")


@query("""
select c_custkey, cast(c_acctbal as decimal(18,2))::double + c_custkey as total, c_custkey || ',234' as cleaned, c_custkey % 3 = 0 as reconciled, substr(sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'), 1, 32) as hashed from customer""")
def q118_number_texts(t):
    k = F.col("c_custkey")
    v = F.col("c_acctbal").cast("decimal(18,2)")
    return t("customer").select(
        k, numbers.sum_numbers(F.concat(F.lit("合计 "), v.cast("string"), F.lit(" 元和 "), k.cast("string"), F.lit(" 元"))).alias("total"), numbers.clean_number_cell(F.concat(k.cast("string"), F.lit(" ,2 34"))).alias("cleaned"),
        numbers.reconcile(v, F.lit(5), F.lit(3), v + 2 + F.when(k % 3 == 0, 0).otherwise(1)).alias("reconciled"), text.content_hash("c_name", "c_custkey").alias("hashed"),
    )


@query("select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def q119_cosine(t):
    e = t("embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("select user_id, event_id, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as nearest from events")
def q120_nearest_marker(t):
    rows = t("events").withColumn("m", F.when(F.col("event_type") == "view", F.col("event_id")))
    return documents.nearest_marker(rows, "user_id", "event_id", "m").select("user_id", "event_id", "nearest")


@query("select o_custkey, string_agg(o_orderkey || 'a,' || o_orderkey || 'b', ',' order by o_orderkey) as rows from orders group by 1")
def q121_continued_sheets(t):
    k = F.col("o_orderkey").cast("string")
    rows = t("orders").select("o_custkey", "o_orderkey", F.array(F.concat(k, F.lit("a")), F.concat(k, F.lit("b"))).alias("rows"))
    return statements.continued(rows, "o_custkey", "o_orderkey", "rows").select("o_custkey", F.array_join("rows", ",").alias("rows"))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def q122_first_party(t):
    return related.first_party(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""
with e as (select distinct l_orderkey as entity, 'trademark' as dimension, l_returnflag as value, 2 as level from lineitem where l_returnflag <> 'A')
select entity, dimension, value, min(entity) over (partition by value) as class_id, count(*) over (partition by value) - 1 as n_links, level from e qualify n_links > 0""")
def q123_intangibles(t):
    marks = t("lineitem").select(F.col("l_orderkey").alias("entity"), F.lit("trademark").alias("dimension"), F.col("l_returnflag").alias("value"))
    generic = marks.sparkSession.createDataFrame([("A",)], "value string")
    return related.intangibles(marks, generic)


@query("select o_orderkey as k, case when o_orderkey % 4 = 0 then 'annotation' else 'code' end as origin from orders")
def q124_replaced_results(t):
    k = t("orders").select(F.col("o_orderkey").alias("k"))
    return report.replace_annotated(k.withColumn("origin", F.lit("code")), k.where("k % 4 = 0").withColumn("origin", F.lit("annotation")), "k")


@query("select o_orderkey from orders where o_orderkey % 6 <> 0")
def q125_pending(t):
    return matching.pending(t("orders").select("o_orderkey"), t("orders").where("o_orderkey % 6 = 0"), "o_orderkey")


@query("select case when o_orderkey % 3 = 0 then '符合' when o_orderkey % 3 = 1 then '不符合' else '未比对' end as verdict, count(*) as n from orders group by 1")
def q126_compliance_progress(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(k.alias("no"), F.concat(F.lit("法" * 25), k.cast("string")).alias("law"))
    done = rows.where("no % 3 < 2").withColumn("verdict", F.when(F.col("no") % 3 == 0, "符合").otherwise("不符合"))
    return matching.compared(rows, done, ["no", "law"], "verdict")[1]


@query("select coalesce(case when o_orderkey % 4 > 0 then o_orderstatus end, '未知') as status, count(*) as n, round(100.0::double * count(*) / (select count(*) from orders), 2) as pct from orders group by 1")
def q127_status_sheet(t):
    return tables.status_sheet(t("orders").select(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("status")), "status")


@query("""
with r as (select o_orderkey as k, o_orderkey % 2 = 0 as passed, case when o_orderkey % 3 = 0 then 'error' when o_orderkey % 3 = 1 then 'warning' else 'info' end as severity from orders)
select 0 as part, '' as key, '- 检查项：' || count(*) || '；问题：' || count(*) filter (not passed and severity = 'error') || '；存疑：' || count(*) filter (not passed and severity = 'warning') as line from r
union all select case severity when 'error' then 1 else 2 end, cast(k as varchar), '- **R' || k % 9 || '** ' || case when k % 5 = 0 then '' else 'd' end from r where not passed and severity <> 'info'""")
def q128_report_lines(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(k.alias("result_id"), (k % 2 == 0).alias("passed"), F.when(k % 3 == 0, "error").when(k % 3 == 1, "warning").otherwise("info").alias("severity"), F.concat(F.lit("R"), (k % 9).cast("string")).alias("rule_name"), F.when(k % 5 != 0, "d").alias("description"))
    return tables.report_lines(rows)


@query("select cast(c_custkey as varchar) as c_custkey, c_name from customer")
def q129_first_row_columns(t):
    k = F.col("c_custkey")
    low = t("customer").agg(F.min("c_custkey").alias("low"))  # one row
    rows = t("customer").join(F.broadcast(low)).select(k, "c_name", F.when(k > F.col("low"), F.col("c_mktsegment")).alias("later"), F.lit("").alias("blank"))
    return tables.first_row_columns(rows, "c_custkey")
