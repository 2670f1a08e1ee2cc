"""All queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import numbers, text
from tallystone.operators import audit, documents, graph, linkage, matching, retrieval
from tallystone.plans.registry import QUERIES, SQL, query

TIE = """
with d as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as detail from lineitem group by 1),
t as (select o_orderkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as stated, detail from orders left join d on l_orderkey = o_orderkey),
r as (select o_orderkey, o_orderstatus, stated, detail, stated - detail as difference, coalesce(abs(stated - detail) <= 0.01, false) as passed from t)
"""
TIE_ROWS = "case when passed then 'info' when detail is null then 'warning' else 'error' end as severity"


def _tied(t) -> DataFrame:
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return audit.tie_out(t("orders"), lines, "o_orderkey", "o_totalprice", "l_extendedprice")


@query(TIE + f"select o_orderkey, cast(stated as double) as stated, cast(detail as double) as detail, cast(difference as double) as difference, passed, {TIE_ROWS} from r")
def q01_order_tieout(t):
    return _tied(t)


@query("""
with a as (select c_mktsegment as seg, cast(o_totalprice as decimal(18,2)) as v from orders join customer on c_custkey = o_custkey),
s as (select seg, sum(v) as footed from a group by 1)
select seg, cast(footed as double) as footed, cast(footed + case when length(seg) % 2 = 0 then 0.02 else 0 end as double) as total,
 cast(case when length(seg) % 2 = 0 then 0.02 else 0 end as double) as difference, length(seg) % 2 <> 0 as passed from s""")
def q02_segment_footing(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("seg"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    # Stated totals, some of them off by two cents.
    off = F.when(F.length("seg") % 2 == 0, F.lit("0.02").cast("decimal(18,2)")).otherwise(F.lit("0").cast("decimal(18,2)"))
    totals = rows.groupBy("seg").agg(F.sum("v").alias("v")).select("seg", (F.col("v") + off).cast("decimal(18,2)").alias("v"), F.lit("total").alias("kind"))
    return audit.footing(rows.withColumn("kind", F.lit("detail")).unionByName(totals), "seg", "v", "kind")


@query("""
with r as (select l_returnflag, cast(l_extendedprice as decimal(18,2)) as gross, cast(l_discount as decimal(18,2)) as part,
 cast(l_extendedprice as decimal(18,2)) - cast(l_discount as decimal(18,2)) + case when l_linenumber = 7 then 0.02 else 0 end as net from lineitem)
select l_returnflag, count(*) as n_rows, cast(sum(case when abs(gross - part - net) <= 0.01 then 0 else 1 end) as bigint) as n_failed from r group by 1""")
def q03_line_crossfoot(t):
    off = F.when(F.col("l_linenumber") == 7, F.lit("0.02").cast("decimal(18,2)")).otherwise(F.lit("0").cast("decimal(18,2)"))
    rows = t("lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("gross"), F.col("l_discount").cast("decimal(18,2)").alias("part"), "l_linenumber")
    rows = rows.withColumn("net", F.col("gross") - F.col("part") + off)
    checked = audit.cross_foot(rows, [(1, "gross"), (-1, "part")], "net")
    return checked.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((~F.col("passed")).cast("long")).alias("n_failed"))


@query("""
with m as (select strftime(o_orderdate, '%Y-%m') as period, sum(cast(o_totalprice as decimal(18,2))) as movement from orders group by 1),
r as (select period, movement, sum(movement) over (order by period) as closing from m)
select period, cast(closing - movement as double) as opening, cast(movement as double) as movement, cast(closing as double) as closing from r""")
def q04_monthly_rollforward(t):
    months = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("movement"))
    return audit.roll_forward(months, "period", "movement").select("period", *[F.col(c).cast("double").alias(c) for c in ("opening", "movement", "closing")])


FLAG_RULES = (
    audit.Rule("S1", ((1, "net", True), (1, "discount", True)), "gross"),
    audit.Rule("S2", ((1, "net", True), (1, "tax", False)), "charged"),
    audit.Rule("S3", ((1, "gross", True), (1, "bonus", False)), "charged"),
)


@query("""
with b as (select l_returnflag as stmt, sum(cast(l_extendedprice as decimal(18,2))) as gross, sum(cast(l_discount as decimal(18,2))) as discount, sum(cast(l_tax as decimal(18,2))) as tax from lineitem group by 1),
i as (select stmt, gross, discount, tax, gross - discount as net, gross - discount + tax as charged from b),
r as (select stmt, 'S1' as rule_id, net + discount as expected, gross as actual, false as part from i union all
 select stmt, 'S2', net + tax, charged, false from i union all select stmt, 'S3', gross, charged, true from i)
select stmt, rule_id, cast(expected as double) as expected, cast(actual as double) as actual, cast(abs(expected - actual) as double) as difference, abs(expected - actual) <= 0.01 as passed,
 case when abs(expected - actual) <= 0.01 then 'info' when part then 'warning' else 'error' end as severity from r""")
def q05_identity_rules(t):
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    b = t("lineitem").groupBy(F.col("l_returnflag").alias("stmt")).agg(money("l_extendedprice").alias("gross"), money("l_discount").alias("discount"), money("l_tax").alias("tax"))
    b = b.withColumn("net", F.col("gross") - F.col("discount")).withColumn("charged", F.col("net") + F.col("tax"))
    items = b.unpivot("stmt", [F.col(c).cast("decimal(24,4)").alias(c) for c in ("gross", "discount", "tax", "net", "charged")], "item", "current")
    return audit.identities(items, FLAG_RULES)


@query(TIE + f", s as (select o_orderstatus, {TIE_ROWS} from r) select o_orderstatus, count(*) as n, count(*) filter (severity = 'error') as n_error, count(*) filter (severity = 'warning') as n_warning, count(*) filter (severity = 'info') as n_info from s group by 1")
def q06_severity_matrix(t):
    results = _tied(t).join(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return audit.severity_matrix(results, "o_orderstatus")


@query("select coalesce(o_orderstatus, 'TOTAL') as o_orderstatus, count(*) as n, round(100.0::double * count(*) / (select count(*) from orders), 4) as pct from orders group by rollup(o_orderstatus)")
def q07_status_share(t):
    return audit.shares(t("orders"), "o_orderstatus")


@query("""
with x as (select distinct conv_id, turn from conversations where turn is not null),
y as (select conv_id, turn, lead(turn) over (partition by conv_id order by turn) as nx from x)
select conv_id, count(*) as n_present, max(turn) - min(turn) + 1 - count(*) as n_missing, min(case when nx > turn + 1 then turn + 1 end) as first_missing from y group by 1""")
def q08_key_gaps(t):
    return documents.gaps(t("conversations"), "conv_id", "turn")


@query("""
with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events),
f as (select user_id, k, k - row_number() over (partition by user_id order by k) as island from e where value < 50)
select user_id, count(*) as run_length, min(k) as first_place from f group by user_id, island having count(*) >= 3""")
def q09_quiet_runs(t):
    return documents.runs(t("events"), "user_id", ["ts", "event_id"], "value < 50", 3).withColumn("first_place", F.col("first_place").cast("long"))


@query("""
with c as (select c_nationkey, c_mktsegment, count(*) as n from customer where c_mktsegment is not null group by all)
select c_nationkey, count(*) as n_values, arg_min(c_mktsegment, (-n, c_mktsegment)) as main_value, max(n) as main_count, count(*) = 1 as consistent from c group by 1""")
def q10_distinct_consistency(t):
    return documents.consistent(t("customer"), "c_nationkey", "c_mktsegment")


@query("""
with terms as (select distinct string_split(text, ' ')[1] as term from benchmark),
w as (select doc_id, term, count(*) as n from (select doc_id, unnest(string_split(text, ' ')) as term from documents) group by all)
select term, count(*) as n_docs, cast(sum(n) as bigint) as n_occurrences from w where term in (select term from terms) group by 1""")
def q11_term_scan(t):
    return documents.term_scan(t("documents"), t("benchmark").select(F.split("text", " ")[0].alias("term")), "doc_id", "text")


SHARED = "select entity, value, min(entity) over (partition by value) as class_id, count(*) over (partition by value) - 1 as n_links"


@query(f"with e as (select c_custkey as entity, c_mktsegment || '/' || cast(floor(c_acctbal / 10) as bigint) as value from customer) {SHARED}, 'balance' as dimension, 2 as level from e qualify n_links > 0")
def q12_shared_fingerprint(t):
    return linkage.shared(_balances(t), "c_custkey", "value", "balance", 2)


def _balances(t) -> DataFrame:
    return t("customer").withColumn("value", F.concat("c_mktsegment", F.lit("/"), F.floor(F.col("c_acctbal") / 10).cast("string")))


#: Two customers a number, every seventh with a mobile one.
SEGMENTS = """n as (select c_custkey as entity, case when c_custkey % 7 = 0 then '13' else '07' end || lpad(cast(c_custkey // 2 as varchar), 9, '0') as number from customer),
 l as (select distinct entity, number, substr(number, 1, length(number) - 1) as value from n where number like '0%' and length(number) >= 10),
 g as (select entity, value, min(entity) over (partition by value) as class_id, count(*) over (partition by value) - count(*) over (partition by value, number) as n_links, 'segment' as dimension, 3 as level from l)"""


def _landlines(t) -> DataFrame:
    half = F.lpad(F.floor(F.col("c_custkey") / 2).cast("string"), 9, "0")
    return t("customer").withColumn("number", F.concat(F.when(F.col("c_custkey") % 7 == 0, "13").otherwise("07"), half))


@query(f"with {SEGMENTS} select * from g where n_links > 0")
def q13_adjacent_keys(t):
    return linkage.adjacent(_landlines(t), "c_custkey", "number")


@query("""
with p as (select p_partkey as entity, 'company-' || p_partkey as name from part),
c as (select entity, name, substr(name, 1, n) as stem from (select entity, name, unnest(range(8, length(name))) as n from p)),
s as (select name as stem, min(entity) as class_id from p group by 1)
select entity, count(*) as n_prefixes, arg_min(class_id, length(c.stem)) as class_id from c join s on s.stem = c.stem group by 1""")
def q14_prefix_link(t):
    return linkage.prefixes(t("part").withColumn("name", F.concat(F.lit("company-"), F.col("p_partkey").cast("string"))), "p_partkey", "name")


@query("""
with s as (select distinct l_suppkey, l_partkey from lineitem), n as (select l_partkey, count(*) as k from s group by 1)
select l_suppkey, count(*) as n_parts, count(*) filter (k > 1) as n_shared_parts, cast(sum(k - 1) as bigint) as n_links from s join n using (l_partkey) group by 1""")
def q15_shared_counterparty(t):
    pairs = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    sizes = pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(sizes, "l_partkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_parts"), F.sum((F.col("k") > 1).cast("long")).alias("n_shared_parts"), F.sum(F.col("k") - 1).alias("n_links"))


@query(f"""
with {SEGMENTS}, e as (select c_custkey as entity, c_mktsegment || '/' || cast(floor(c_acctbal / 10) as bigint) as value, 'balance' as dimension, 2 as level from customer),
h as (select entity, dimension, level, count(*) over (partition by dimension, value) - 1 as n_links from e qualify n_links > 0 union all select entity, dimension, level, n_links from g where n_links > 0)
select entity, max(level) as max_level, cast(sum(n_links) as bigint) as n_links, string_agg(distinct dimension, '|' order by dimension) as dimensions,
 case max(level) when 3 then 'related' when 2 then 'suspicious' else 'minor' end as verdict from h group by 1""")
def q16_hit_rollup(t):
    return linkage.roll_up([linkage.shared(_balances(t), "c_custkey", "value", "balance", 2), linkage.adjacent(_landlines(t), "c_custkey", "number")])


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def q17_semi_marked(t):
    urgent = t("orders").where(F.col("o_orderpriority").startswith("1"))
    return t("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def q18_anti_missing(t):
    urgent = t("orders").where(F.col("o_orderpriority").startswith("1"))
    return t("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
with a as (select distinct regexp_replace(s_name, '[^0-9]', '', 'g') as name from supplier), b as (select distinct regexp_replace(c_name, '[^0-9]', '', 'g') as name from customer where c_custkey % 3 = 0)
select coalesce(a.name, b.name) as name, case when a.name is null then 'extra' when b.name is null then 'missed' else 'matched' end as status from a full join b on a.name = b.name""")
def q19_name_reconcile(t):
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "").alias("name")
    # Every third customer is on the second list; the rest are what it misses.
    return linkage.reconcile_names(t("supplier").select(digits("s_name")), t("customer").where("c_custkey % 3 = 0").select(digits("c_name")), "name")


@query("""
with recursive e as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
w as (select 'r' || r_regionkey as node, 0 as depth from region union all select child, depth + 1 from w join e on parent = node where depth < 5)
select depth, count(*) as n_nodes from (select node, min(depth) as depth from w group by 1) group by 1""")
def q20_ownership_depth(t):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = t("nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(t("customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    roots = t("region").select(name("r", "r_regionkey").alias("node"))
    return graph.reach(edges, roots).groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


STEPS = "select distinct l_partkey as src, l_suppkey as dst from lineitem"


def _steps(t) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query(f"""
with e as ({STEPS}), n as (select s_suppkey as node from supplier where s_suppkey % 10 <> 9 union all select s_suppkey from supplier where s_suppkey % 50 = 1),
m as (select a.src from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst),
k as (select (select count(*) from (select node from n group by 1 having count(*) > 1)) as n_duplicates, (select count(*) from e where dst not in (select node from n)) as n_dangling,
 (select count(distinct node) from n where node not in (select src from e) and node not in (select dst from e)) as n_isolated, (select count(*) from m) as n_mutual)
select *, greatest(0, 100 - 20 * (n_duplicates + n_dangling) - 5 * (n_isolated + n_mutual)) as score from k""")
def q21_graph_validate(t):
    ids = t("supplier").select(F.col("s_suppkey").alias("node"))
    # Of all suppliers one in ten is missing and one in fifty listed twice.
    return graph.validate(ids.where("node % 10 <> 9").unionByName(ids.where("node % 50 = 1")), _steps(t))


@query(f"with e as ({STEPS}) select a.src as a, a.dst as b from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def q22_mutual_edges(t):
    return graph.mutual(_steps(t))


TOP = """
with q as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id % 50 = 0), v as (select vec_id, cast(embedding as double[]) as e, label from embeddings {where}),
s as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 5) as score from q cross join v)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 15"""


@query(TOP.format(where=""))
def q23_vector_topk(t):
    v = t("embeddings")
    return retrieval.top_k(v, v.where("vec_id % 50 = 0"), 15)


@query(TOP.format(where="where label = 3"))
def q24_labelled_topk(t):
    v = t("embeddings")
    return retrieval.top_k(v.where("label = 3"), v.where("vec_id % 50 = 0"), 15)


@query("""
with c as (select doc_id, md5('doc' || doc_id) as h, unnest(range(0, greatest(length(text), 1), 680)) as s, text from documents)
select doc_id, s // 680 as chunk_index, substr(h, 1, 16) || '-' || lpad(cast(s // 680 as varchar), 4, '0') as chunk_id, length(substr(text, s + 1, 800)) as n_chars, md5(substr(text, s + 1, 800)) as digest from c where length(substr(text, s + 1, 800)) >= 50""")
def q26_chunk_ids(t):
    rows = retrieval.fixed_chunks(t("documents").select("doc_id", "text"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "text")
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("""
with k as (select *, lag(text) over (partition by conv_id order by turn) as b from conversations)
select conv_id, count(*) as n_parts, string_agg(text, chr(10) order by turn, text) as text from k where b is null or b <> text group by 1""")
def q27_thread_reassembly(t):
    return documents.reassemble(t("conversations"), "conv_id", "turn", "text")


@query("select label, count(*) as n, count(distinct vec_id) as n_ids from embeddings group by 1")
def q28_collection_counts(t):
    return t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"))


@query("select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) as heading, len(regexp_extract_all(html, '<p>')) as n_paragraphs from pages")
def q29_html_headings(t):
    return t("pages").select("page_id", F.trim(text.strip_html(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1))).alias("heading"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


@query("select regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^([^/?#:]*)', 1), '^www\\.', '') as host, count(*) as n from pages group by 1")
def q30_url_hosts(t):
    return t("pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with m as (select doc_id, list_distinct(regexp_extract_all(lower(regexp_replace('写信给<br>张三@Firm' || doc_id || '.cn, ' || text, '<[^>]+>', '', 'g')), '([\\pL\\pN_.+-]+@[\\pL\\pN_.-]+\\.[\\pL\\pN_]{2,})', 1)) as e from documents)
select doc_id, array_to_string(list_sort(e), '|') as emails, len(e) as n_emails from m where len(e) > 0""")
def q31_contact_extract(t):
    written = F.concat(F.lit("写信给<br>张三@Firm"), F.col("doc_id").cast("string"), F.lit(".cn, "), "text")
    rows = t("documents").select("doc_id", text.emails(written).alias("e")).where(F.size("e") > 0)
    return rows.select("doc_id", F.array_join(F.array_sort("e"), "|").alias("emails"), F.size("e").cast("long").alias("n_emails"))


@query("""
with g as (select d.doc_id, quality, length(text) >= 200 as long_enough, len(regexp_extract_all(text, '\\.')) >= 3 as has_sentences, len(regexp_extract_all(text, '\\|')) <= 5 as few_bars from documents d join labels using (doc_id))
select quality, cast(long_enough as int) + cast(has_sentences as int) + cast(few_bars as int) as gates_passed, count(*) as n from g group by all""")
def q32_quality_gates(t):
    body = F.col("text")
    gates = [F.length(body) >= 200, F.regexp_count(body, F.lit(r"\.")) >= 3, F.regexp_count(body, F.lit(r"\|")) <= 5]
    rows = t("documents").join(t("labels"), "doc_id").withColumn("gates_passed", sum(g.cast("int") for g in gates))
    return rows.groupBy("quality", "gates_passed").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) - 2 * sum(case when l_linenumber = 3 then cast(l_extendedprice as decimal(18,2)) else 0 end) as double) as total from lineitem group by 1")
def q33_amount_parse(t):
    shown = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    written = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("（"), F.replace(shown, F.lit(","), F.lit("，")), F.lit("）"))).otherwise(shown)
    rows = t("lineitem").select("l_returnflag", numbers.parse_number(written).cast("decimal(18,2)").alias("v"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


@query("select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank from orders qualify rank <= 4")
def q34_last_n_periods(t):
    rows = matching.last_n(t("orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 4)
    return rows.select("o_custkey", "o_orderkey", "o_orderdate", F.col("rank").cast("long").alias("rank"))


@query("select event_type, count(*) as n, max(ts) as latest from events where ts >= (select max(ts) from events) - interval 7 day group by 1")
def q35_since_date(t):
    e = t("events")
    last = e.agg(F.max("ts").alias("__last"))  # one row
    return e.join(F.broadcast(last), F.col("ts") >= F.col("__last") - F.expr("interval 7 days")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def q36_page_slice(t):
    return t("orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@query("""
with n as (select distinct p_brand as name from part)
select name, p_partkey, p_size from n join part on p_brand = name qualify row_number() over (partition by name order by (p_size >= 25)::int desc, p_partkey) = 1""")
def q37_best_match(t):
    records = t("part").withColumn("valid", F.col("p_size") >= 25)
    return matching.best_match(t("part").select(F.col("p_brand").alias("name")).distinct(), records, "name", "p_brand", "valid", "p_partkey").select("name", "p_partkey", "p_size")


@query("""
with n as (select distinct regexp_extract(c_name, '[0-9]+') as name from customer), a as (select distinct regexp_extract(s_name, '[0-9]+') as name from supplier where s_suppkey % 2 = 0), b as (select distinct regexp_extract(s_name, '[0-9]+') as name from supplier)
select name, case when name in (select name from a) then 'first' when name in (select name from b) then 'second' else 'none' end as origin from n""")
def q38_two_source_fallback(t):
    digits = lambda c: F.regexp_extract(c, "[0-9]+", 0).alias("name")
    s = t("supplier")
    return matching.with_fallback(t("customer").select(digits("c_name")).distinct(), s.where("s_suppkey % 2 = 0").select(digits("s_name")).distinct(), s.select(digits("s_name")).distinct(), "name")


@query()
def q39_recursive_chunks(t):
    return retrieval.recursive_chunks(t("documents"), "doc_id", "text")


@query("""
with f as (select event_type, min(event_id) as first from events group by 1), l as (select event_type, row_number() over (order by first) as lane_no from f)
select event_id, lane_no, row_number() over (partition by event_type order by event_id) as row_no from events join l using (event_type)""")
def q40_lane_layout(t):
    rows = graph.lanes(t("events"), "event_type", "event_id")
    return rows.select("event_id", F.col("lane_no").cast("long").alias("lane_no"), F.col("row_no").cast("long").alias("row_no"))


from tallystone.plans import basics, checks, intake, mechanisms, reports  # noqa: E402, F401 - register their queries, which build on those above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
