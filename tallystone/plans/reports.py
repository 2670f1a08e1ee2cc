"""Queries of table gates, company names and the display of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators import companies, display, gates, graph, linkage, related
from tallystone.plans.registry import query

ITEMS = ["资产总计", "负债合计", "股东权益合计", "营业收入", "营业成本", "营业利润", "利润总额", "净利润", "合计", "美元", "人民币", "其中：股本"]
EQUITY = gates.EQUITY_ITEMS
HEADERS = [
    ["项目", "期末余额", "年初余额"], ["项目", "2024年度", "2023年度"], ["项目", "期初数", "本期增加", "期末数"], ["项目", "本期金额", "合计金额", "上期"], ["甲", "乙"],
    ["项目", "期初", "增加", "减少", "期末余额"], ["股本", "2024", "本期金额", "2023", "上期金额"],
]

#: A table for each order: a row a line, four times over for every eleventh one, headers by the key's remainder.
TABLES = f"""
with l as (select l_orderkey as k, l_linenumber as n, [case when l_orderkey % 7 = 6 then {EQUITY}[1 + l_linenumber % 6] else {ITEMS}[1 + (l_orderkey + l_linenumber) % 12] end,
 case when l_orderkey % 3 = 0 then '' else cast(cast(l_extendedprice as decimal(18,2)) as varchar) end, cast(cast(l_quantity as bigint) as varchar)] as c from lineitem),
g as (select k, list(c order by n, c) as r from l group by k),
t as (select k, case when k % 11 = 0 then r || r || r || r else r end as rows, {HEADERS}[1 + k % 7] as headers from g),
x as (select *, array_to_string(headers, ' ') as h, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' ')), ' ') as txt, len(rows) as n from t)
"""


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _tables(t) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    name = F.when(k % 7 == 6, F.get(_texts(EQUITY), (n % 6).cast("int"))).otherwise(F.get(_texts(ITEMS), ((k + n) % 12).cast("int")))
    price = F.when(k % 3 == 0, "").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    lines = t("lineitem").select(k.alias("k"), n.alias("n"), F.array(name, price, F.col("l_quantity").cast("long").cast("string")).alias("c"))
    rows = lines.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]).alias("r"))
    return rows.select("k", F.when(F.col("k") % 11 == 0, F.flatten(F.array_repeat("r", 4))).otherwise(F.col("r")).alias("rows"), F.get(F.array(*[_texts(h) for h in HEADERS]), (F.col("k") % 7).cast("int")).alias("headers"))


@query(TABLES + """
select k, n between 1 and 20 and regexp_matches(h, '金额|余额|价值|合计|小计|元') and not (contains(txt, '美元') and contains(txt, '人民币'))
 and (len(list_filter(rows, lambda r: regexp_matches(r[1], '合计|总计|小计'))) > 0 or len(list_filter(rows, lambda r: regexp_matches(array_to_string(r, ' '), '[0-9]'))) >= n * 0.3) as useful,
 regexp_matches(h, '金额|余额|价值|元|合计|小计|总计') and not (regexp_matches(h, '期末余额|年初余额') and n > 20) as note_table,
 len(list_filter(rows[1:10], lambda r: regexp_matches(r[1], '营业收入|营业利润|利润总额|净利润'))) > 2 as summary,
 case when k % 7 in (0, 2, 5) then case when contains(h, '期初') and contains(h, '期末') and contains(h, '增加') and contains(h, '减少') then '复杂横加' else '变动表' end else '复杂横加' end as reason,
 k % 5 = 0 and not (contains(txt, '美元') and contains(txt, '人民币') and len(list_filter(rows, lambda r: contains(r[1], '合计'))) > 0) as prefiltered from x""")
def q88_table_gates(t):
    headers, rows = F.col("headers"), F.col("rows")
    tables = _tables(t).withColumn("kind", F.when(F.col("k") % 5 == 0, "note_detail").otherwise("title"))
    kept = gates.prefiltered(tables, "kind", "headers", "rows").select("k", F.lit(True).alias("__kept"))
    shown = tables.select("k", gates.useful(headers, rows).alias("useful"), gates.note_table(headers, rows).alias("note_table"), gates.names_subjects(rows, ["营业收入", "营业利润", "利润总额", "净利润"]).alias("summary"), gates.candidate_reason(headers).alias("reason"))
    return shown.join(kept, "k", "left").withColumn("prefiltered", F.coalesce("__kept", F.lit(False))).drop("__kept")


CLAIMS = "regexp_matches(txt, '负债合计|所有者权益合计|股东权益合计|负债和所有者权益总计|负债及所有者权益总计')"


@query(TABLES + f""", s as (select k, contains(txt, '资产总计') as a, {CLAIMS} as c, contains(txt, '资产总计') and contains(txt, '负债合计') and regexp_matches(txt, '(所有者|股东)权益合计') as f,
 (contains(txt, '营业收入')::int + contains(txt, '营业成本')::int + contains(txt, '营业利润')::int + contains(txt, '利润总额')::int + contains(txt, '净利润')::int) / 5.0::double as income,
 (contains(txt, '股本')::int + contains(txt, '资本公积')::int + contains(txt, '盈余公积')::int + contains(txt, '未分配利润')::int + contains(txt, '所有者权益合计')::int + contains(txt, '股东权益合计')::int) / 6.0::double as e from x)
select k, case when a and c then 'complete' when a then 'assets' when c then 'claims' end as part, case when f then 1.0 when a and c then 0.8 when a or c then 0.5 else 0.0 end::double as balance, income, 0.0::double as cash, case when k % 7 = 6 and e >= 0.6 then e else 0.0 end as equity from s""")
def q89_statement_scores(t):
    scores = gates.statement_scores(F.col("headers"), F.col("rows"))
    return _tables(t).select("k", gates.balance_part(F.col("rows")).alias("part"), scores.alias("s")).select("k", "part", "s.*")


@query(TABLES + """
select k, case when k % 7 = 4 then 1 else 2 end::int as value_column,
 case k % 7 when 1 then 2024 when 6 then 2024 end::int as year, case k % 7 when 1 then '2024' when 2 then 'current' when 3 then 'current' when 6 then '2024' else '' end as period,
 case when len(list_filter(rows, lambda r: regexp_matches(r[1], '合计|总计|小计'))) > 0 then try_cast(list_filter(rows, lambda r: regexp_matches(r[1], '合计|总计|小计'))[1][3] as double) else list_sum(list_transform(rows, lambda r: cast(r[3] as double))) end as total,
 round(case when len(list_filter(rows, lambda r: regexp_matches(r[1], '合计|总计|小计'))) > 0 then coalesce(try_cast(list_filter(rows, lambda r: regexp_matches(r[1], '合计|总计|小计'))[1][2] as double), cast(list_filter(rows, lambda r: regexp_matches(r[1], '合计|总计|小计'))[1][3] as double))
  when k % 3 = 0 then list_sum(list_transform(rows, lambda r: cast(r[3] as double))) else list_sum(list_transform(rows, lambda r: cast(r[2] as double))) end, 2) as first_total,
 md5(h || chr(10) || array_to_string(list_transform(rows, lambda r, i: (i - 1) || ': ' || array_to_string(r, ' ')), chr(10))) as prompt from x""")
def q90_table_values(t):
    headers, rows = F.col("headers"), F.col("rows")
    return _tables(t).select(
        "k", gates.matrix_value_column(headers, rows).alias("value_column"), gates.header_year(headers).alias("year"), gates.matrix_period(headers).alias("period"), gates.table_total(rows, F.lit(2)).alias("total"),
        F.round(gates.table_total(rows), 2).alias("first_total"), F.md5(gates.prompt_text(headers, rows)).alias("prompt"),
    )


@query(TABLES + """, v as (select k, k % 13 <> 0 and k % 6 <> 0 as valid from t)
select k, valid, k % 5 < 3 and case when valid then (k % 10) / 10.0 else (k % 10) / 10.0 - 0.3 end >= 0.6 as accepted from v""")
def q91_sheet_roles(t):
    k = F.col("k")
    item = F.when(k % 13 != 0, F.lit(0))
    valid = gates.sheet_valid(F.col("rows"), item, F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(2)), F.lit(2))
    role = F.when(k % 5 == 3, "附注").when(k % 5 == 4, "其他").otherwise("利润表")
    return _tables(t).select("k", valid.alias("valid"), gates.accepted_role(role, k % 10 / 10, valid).alias("accepted"))


@query("""
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as n, first_value(o_orderkey % 2 = 0) over (partition by o_custkey order by o_orderkey) as f from orders)
select o_custkey, o_orderkey, case when k > 2 then null when n = 1 or (k = 1) = f then 'consolidated' else 'parent' end as scope from r""")
def q92_statement_scopes(t):
    return gates.split_scopes(t("orders"), ["o_custkey"], "o_orderkey", F.col("o_orderkey") % 2 == 0).select("o_custkey", "o_orderkey", "scope")


@query("""
with f as (select o_custkey, o_orderstatus, arg_min(o_totalprice, o_orderkey) as v from orders where o_orderstatus in ('F', 'O') group by all)
select o_custkey, max(v) filter (o_orderstatus = 'F') as finished, max(v) filter (o_orderstatus = 'O') as open from f group by 1""")
def q93_item_lookup(t):
    return gates.lookup(t("orders"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey", {"finished": "F", "open": "O"})


@query("""
with f as (select l_orderkey, max(cast(l_extendedprice as double)) filter (l_linenumber = 1) as opening, max(cast(l_extendedprice as double)) filter (l_linenumber = 3) as closing from lineitem group by 1)
select l_orderkey, 'R10' as rule_id, case when opening is not null then closing end as expected, case when opening is not null then closing end as actual, case when opening is not null and closing is not null then 0.0::double end as difference,
 opening is not null and closing is not null as passed, case when opening is not null and closing is not null then 'info' else 'error' end as severity from f""")
def q94_equity_balances(t):
    item = F.when(F.col("l_linenumber") == 1, gates.EQUITY_OPENING).when(F.col("l_linenumber") == 3, gates.EQUITY_CLOSING).otherwise("综合收益总额")
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_extendedprice").cast("double")).alias("v")).withColumn("item", item)
    return gates.equity_balances(rows, "l_orderkey", "item", "v", "l_linenumber")


@query("select distinct l_orderkey, o_orderkey, o_orderstatus from (select l_orderkey, unnest([l_orderkey, l_partkey, l_suppkey]) as o_orderkey from lineitem) join orders using (o_orderkey)")
def q95_mapped_tables(t):
    """Notes that name the tables of an order, and of what is numbered as its parts and suppliers."""
    ids = F.array(*[F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    notes = t("lineitem").select("l_orderkey", F.explode(ids).alias("i")).distinct().groupBy("l_orderkey").agg(F.collect_list("i").alias("table_ids"))
    return gates.mapped_tables(notes, t("orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus"), "table_ids", "o_orderkey")


@query(TABLES + """
select s as statement, cast(arg_min(k % 40, k) as bigint) as page from (select unnest(['balance', 'income', 'equity']) as s), x
where k % 9 <> 0 and case s when 'balance' then contains(txt, '资产总计') when 'income' then regexp_matches(txt, '营业收入|净利润') else contains(txt, '盈余公积') end group by 1""")
def q96_statement_pages(t):
    tables = _tables(t).withColumn("page", F.when(F.col("k") % 9 != 0, (F.col("k") % 40).cast("long")))
    return gates.statement_pages(tables, "page", "k", gates.table_text(F.col("rows")), {"balance": ["资产总计"], "income": ["营业收入", "净利润"], "equity": ["盈余公积"]})


@query("select name, count(*) as n from (select case l_linenumber when 1 then '其中：甲' when 2 then '项目' else '货币资金' end as name, case when l_orderkey % 5 = 0 then '编制单位：甲' else '' end as raw from lineitem) where not (name = '项目' or contains(name, '其中') or raw <> '') group by 1")
def q97_skipped_items(t):
    n = F.col("l_linenumber")
    rows = t("lineitem").select(F.when(n == 1, "其中：甲").when(n == 2, "项目").otherwise("货币资金").alias("name"), F.when(F.col("l_orderkey") % 5 == 0, "编制单位：甲").otherwise("").alias("raw"))
    return rows.where(~gates.skipped_item(F.col("name"), F.col("raw"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""
with c as (select c_custkey as k, '甲' || c_custkey || '星股份' as main, case when c_custkey % 4 = 0 then '乙' || c_custkey || '月' else '甲' || c_custkey || '星股份' end as prep, case when c_custkey % 6 = 0 then '丙' || c_custkey || '日' else '甲' || c_custkey || '星股份' end as listed from customer),
r as (select *, (prep <> main)::int + (listed <> main)::int + (k % 4 = 0)::int as n from c where k % 10 <> 9)
select k, main as main_core, 2 + (k % 4 <> 0)::int as n_mentions, n as n_conflicts, n = 0 as passed, case when n = 0 then 'info' else 'warning' end as severity from r
union all select k, '' , 0, 0, true, 'info' from c where k % 10 = 9""")
def q98_company_consistency(t):
    k = F.col("c_custkey")
    name = lambda first, last: F.concat(F.lit(first), k.cast("string"), F.lit(last))
    main = F.concat(name("甲", "星"), F.lit("股份有限公司"))
    prep = F.when(k % 4 == 0, F.concat(name("乙", "月"), F.lit("有限公司"))).otherwise(main)
    text = F.concat(main, F.lit("\n编制单位："), prep, F.lit(" 2024 年度\n正文。"), main, F.lit("，本公司及该有限公司。"))
    text = F.when(k % 10 == 9, F.lit("没有名称")).otherwise(text)
    listed = F.when(k % 10 == 9, None).when(k % 6 == 0, F.concat(name("丙", "日"), F.lit("集团（表）"))).otherwise(main)
    return companies.company_consistency(t("customer").select(k.alias("k"), text.alias("text"), listed.alias("listed")), "k", "text", "listed")


@query("select c_custkey, '甲' || c_custkey || '集团' as legal, '甲' || c_custkey as core, '2024年' || (c_custkey % 12 + 1) || '月3日' as period, '甲' || c_custkey || '集团（北京）' as preparer from customer")
def q99_company_names(t):
    k = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("甲"), k, F.lit("集团"))
    text = F.concat(F.lit("编制单位: "), name, F.lit("（北京）；于 2024 年 "), (F.col("c_custkey") % 12 + 1).cast("string"), F.lit(" 月 3 日"))
    return t("customer").select("c_custkey", companies.legal_name(F.concat(name, F.lit("（北京）"))).alias("legal"), companies.core_name(name).alias("core"), companies.period_of(text).alias("period"), companies.prepared_by(text).alias("preparer"))


KINDS = ["报表间", "表注", "附注内", "横加", "竖加", "文本", "其他类"]
LEVELS = ["error", "warning", "info"]


@query(f"""
with r as (select o_orderkey as k, {KINDS}[1 + o_orderkey % 7] as kind, {LEVELS}[1 + o_orderkey % 3] as level, o_orderkey % 5 = 0 as passed, case when o_orderkey % 2 = 0 then '表格ID ' || o_orderkey || '：利润表' else '附注五' end as loc, case when o_orderkey % 4 <> 0 then cast(o_orderkey % 60 as varchar) end as page,
 case when o_orderkey % 3 = 1 then '明细' else '' end as ctx from orders), b as (select *, case when k % 2 = 0 then '利润表' else loc end as bare, '（第' || coalesce(page, '') || '页）' as told from r)
select k, case when kind = '竖加' and contains(loc, '利润表') then '报表内勾稽' when kind = '报表间' then '报表内勾稽' when kind = '表注' then '表注勾稽' when kind = '附注内' then '附注内勾稽' when kind in ('横加', '竖加') then '横加竖加' when kind = '文本' then '文本格式' else kind end as sheet,
 case when passed or level = 'info' then '通过' when level = 'error' then '问题' else '存疑' end as label,
 case when kind = '报表间' then bare || told when kind in ('横加', '竖加') then case when ctx <> '' then ctx else bare end || told when kind = '文本' then case when page is null then '全文检查' else '第' || page || '页' end when page is null then bare else bare || told end as location,
 case when k % 8 = 0 then '已核对' when not passed and level = 'warning' then '存疑' else 'x' end as conclusion, case when k % 4 = 0 then 'column|percent' when k % 4 = 1 then 'parts' when k % 4 = 2 then 'total' else 'none' end as hints from b""")
def q100_result_display(t):
    k = F.col("o_orderkey")
    kind, level, passed = F.get(_texts(KINDS), (k % 7).cast("int")), F.get(_texts(LEVELS), (k % 3).cast("int")), k % 5 == 0
    place = F.when(k % 2 == 0, F.concat(F.lit("表格ID "), k.cast("string"), F.lit("：利润表"))).otherwise("附注五")
    page, context = F.when(k % 4 != 0, (k % 60).cast("string")), F.when(k % 3 == 1, "明细").otherwise("")
    evidence = F.when(k % 8 == 0, "y Agent复核： 已核对[1]").otherwise("x")
    hints = display.review_hints(F.when(k % 4 == 0, "金额列 Rate"), F.when(k % 4 == 1, "其中").when(k % 4 == 2, "合计"), F.lit(None).cast("string"), F.when(k % 4 == 2, "0.00"))
    conclusion = display.review_conclusion(evidence, passed, level, kind)
    return t("orders").select(
        k.alias("k"), display.sheet_category(kind, place).alias("sheet"), display.result_label(passed, level).alias("label"), display.location_text(kind, place, page, context).alias("location"),
        F.when(conclusion.startswith("存疑："), "存疑").otherwise(conclusion).alias("conclusion"), hints.alias("hints"),
    )


@query("""
select p_partkey, case p_partkey % 4 when 0 then '#FF0000' when 1 then '#2C3E50' when 2 then '#AB12CD' else '#000000' end as colour, cast(round_even(p_size / 10.0, 0) * 10 as bigint) as x, p_partkey % 3 = 0 as dashed,
 '&lt;' || p_name || '&gt; &amp; &quot;&#x27;' as label, case p_size % 6 when 1 then '已废止' when 2 then '已修改' when 3 then '有效' when 4 then '尚未生效' else '未知' end as state from part""")
def q101_diagram_values(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 4 == 0, " Red ").when(k % 4 == 1, "深蓝色").when(k % 4 == 2, "#ab12cd").otherwise("mauve")
    return t("part").select(
        k, display.colour(name).alias("colour"), display.on_grid(size).alias("x"), display.dashed(F.when(k % 3 == 0, "不符合").when(k % 3 == 1, "是")).alias("dashed"),
        display.xml_escaped(F.concat(F.lit("<"), "p_name", F.lit("> & \"'"))).alias("label"), display.decoded((size % 6).cast("int"), display.LAW_STATES, "未知").alias("state"),
    )


@query("""
select c_custkey, case c_custkey % 3 when 0 then 'a' || c_custkey when 1 then 'b' || c_custkey end as picked, 'n' || c_custkey || ' - m' || c_custkey as substituted,
 cast(cast(c_acctbal as decimal(18,2)) as varchar) as shown, case when c_custkey % 2 = 0 then cast(c_custkey as bigint) end as answer from customer""")
def q102_value_texts(t):
    k = F.col("c_custkey")
    say = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    values = F.create_map(F.lit("期末余额"), F.when(k % 3 == 0, say("a")).otherwise("-"), F.lit("账面价值合计"), F.when(k % 3 == 1, say("b")).otherwise(""))
    formula = display.substituted(F.lit("存货原值 - 存货"), F.create_map(F.lit("存货"), say("m"), F.lit("存货原值"), say("n")))
    answer = F.when(k % 2 == 0, F.concat(F.lit("Here:\n```json\n{\"v\": "), k.cast("string"), F.lit("}\n```"))).otherwise("no answer")
    return t("customer").select(
        k, display.picked(values, ["期末余额", "账面价值"]).alias("picked"), formula.alias("substituted"), display.fixed_two(F.col("c_acctbal").cast("decimal(18,2)")).alias("shown"),
        display.fenced_json(answer, "v long")["v"].alias("answer"),
    )


@query("""
with h as (select page_id, html from pages)
select page_id, case page_id % 3 when 0 then 'Head ' || page_id || '|Two|Three' when 1 then 'bold ' || page_id else 'line ' || page_id || '|' || repeat('x', 50) || '...' end as findings, 'a' || chr(10) || chr(10) || 'b' || page_id as compact from h""")
def q103_key_findings(t):
    k = F.col("page_id").cast("string")
    heads = F.concat(F.lit("# T\n## Head "), k, F.lit("\n## Two\ntext **b**\n## Three\n## Four\n"))
    bold = F.concat(F.lit("# T\nsome **bold "), k, F.lit("** text"))
    plain = F.concat(F.lit("# T\n  line "), k, F.lit("\n\n" + "x" * 60))
    text = F.when(F.col("page_id") % 3 == 0, heads).when(F.col("page_id") % 3 == 1, bold).otherwise(plain)
    return t("pages").select("page_id", F.array_join(display.key_findings(text), "|").alias("findings"), display.without_blank_runs(F.concat(F.lit("\n a  \n \n\n\nb"), k, F.lit("  \n\n"))).alias("compact"))


@query("""
select o_orderkey as k, '报表间' as check_type, 'tie' as rule_name, case when o_orderkey % 2 = 0 then 'info' else 'error' end as severity, o_orderkey % 2 = 0 as passed, '' as description, cast(cast(o_totalprice as decimal(18,2)) as varchar) as expected, '' as actual,
 case when o_orderkey % 2 = 1 then cast(cast(o_totalprice as decimal(18,2)) as varchar) else '' end as difference, 1.0::double as confidence from orders""")
def q104_results(t):
    k, v = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    made = display.result("报表间", "tie", F.when(k % 2 == 0, "info").otherwise("error"), k % 2 == 0, F.lit(None), v, None, F.when(k % 2 == 1, v))
    return t("orders").select(k.alias("k"), made.alias("r")).select("k", "r.*")


@query("select c_custkey, 'now ' || c_custkey || case when c_custkey % 2 = 0 then '|invoice' else '' end || case when c_custkey % 3 = 0 then '|old' else '' end as addresses from customer")
def q105_all_addresses(t):
    k = F.col("c_custkey")
    change = lambda item, before: F.struct(F.lit(item).alias("item"), F.lit(before).alias("before"))
    changes = F.when(k % 3 == 0, F.array(change("地址变更", "old"), change("名称变更", "x"), change("地址变更", ""))).otherwise(F.array(change("名称变更", "y")))
    return t("customer").select(k, F.array_join(display.all_addresses(F.array(F.concat(F.lit("now "), k.cast("string"))), F.when(k % 2 == 0, "invoice"), changes), "|").alias("addresses"))


@query("""
with c as (select c_custkey as k, case when c_custkey % 7 = 0 then '0107777777' else '010' || lpad(cast(c_custkey // 2 * 2 + (c_custkey % 5) // 3 as varchar), 7, '0') end as n from customer)
select a.k as entity, substr(a.n, 1, length(a.n) - 1) as value, (select min(k) from c x where substr(x.n, 1, length(x.n) - 1) = substr(a.n, 1, length(a.n) - 1)) as class_id, count(*) as n_links, 'phone_segment' as dimension, 3 as level
from c a join c b on substr(a.n, 1, length(a.n) - 1) = substr(b.n, 1, length(b.n) - 1) and a.n <> b.n group by a.k, a.n""")
def q130_phone_segments(t):
    """Numbers that several companies share and that are next to others', tested pair by pair."""
    k = F.col("c_custkey")
    number = F.floor(k / 2) * 2 + F.floor(k % 5 / 3)
    phone = F.when(k % 7 == 0, "010-7777777").otherwise(F.concat(F.lit("010-"), F.lpad(number.cast("string"), 7, "0")))
    return related.phone_segments(t("customer").select(k.alias("k"), phone.alias("phone")), "k")


@query("select c_custkey as entity, c_custkey - 1 as class_id, 1 as n_links, 'address_prefix' as dimension, 2 as level from customer where c_custkey % 2 = 1")
def q131_address_prefixes(t):
    k = F.col("c_custkey")
    place = F.concat(F.lit("北京市海淀区中关村大街"), F.lpad(F.floor(k / 2).cast("string"), 12, "0"), F.when(k % 2 == 1, "号 3 层").otherwise("号"))
    return related.address_prefixes(t("customer").select(k, place.alias("address")), "c_custkey")


@query("""
with l as (select distinct 'N' || lpad(cast(c_custkey as varchar), 6, '0') || '（甲）' as name, c_custkey as k from customer), r as (select 'N' || lpad(cast(s_suppkey * 2 as varchar), 6, '0') || '(甲)' as name, s_suppkey as k from supplier),
m as (select name from l where replace(replace(name, '（', '('), '）', ')') not in (select name from r))
select m.name, arg_min(r.name, r.k) as likely from m left join r on contains(r.name, substr(m.name, 1, 4)) group by 1""")
def q132_likely_names(t):
    name = lambda c, end: F.concat(F.lit("N"), F.lpad(c.cast("string"), 6, "0"), F.lit(end)).alias("name")
    return linkage.likely_names(t("customer").select(name(F.col("c_custkey"), "（甲）")), t("supplier").select(name(F.col("s_suppkey") * 2, "(甲)"), F.col("s_suppkey").alias("k")), "name", "k")


@query("""
with e as (select event_id, unnest(list_filter([case when event_id % 11 = 0 then 'null id' end, case when event_id % 7 = 0 then 'null step' end, case when event_id % 5 = 0 then 'unknown type' end, case when event_id % 7 = 1 then 'blank step' end,
 case when event_id % 3 = 0 then 'null target' end, case when event_id % 3 = 0 then 'blank target' end], lambda x: x is not null)) as error from events)
select error, count(*) as n, min(event_id) as first from e group by 1""")
def q133_node_fields(t):
    k = F.col("event_id")
    nodes = t("events").select(
        k.alias("k"), F.when(k % 11 != 0, k.cast("string")).alias("id"), F.when(k % 7 == 1, "  ").when(k % 7 > 1, "s").alias("step"), F.when(k % 5 == 0, "loop").otherwise("process").alias("type"), F.lit("r").alias("swimlane_role"), F.lit("n").alias("node_role"),
        F.when(k % 3 == 0, F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("x"))).alias("next_steps"),
    )
    return graph.field_errors(nodes, "k", "next_steps").groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))


@query("""
with n as (select user_id, event_id, min(event_id) over (partition by user_id) as lo, max(event_id) over (partition by user_id) as hi, count(*) over (partition by user_id) as c, event_id % 4 = 0 as points from events), p as (select distinct user_id, event_id + 1 as event_id from n where points)
select user_id, event_id from n where not points and c >= 3 and event_id <> lo and event_id <> hi and not exists (select 1 from p where p.user_id = n.user_id and p.event_id = n.event_id)""")
def q134_isolated_nodes(t):
    k = F.col("event_id")
    nodes = t("events").select("user_id", "event_id", F.when(k % 4 == 0, F.array(k + 1)).alias("next_steps"))
    return graph.isolated(nodes, "user_id", "event_id", "event_id", "next_steps")
