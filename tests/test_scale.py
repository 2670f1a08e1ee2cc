"""What larger tables brought to light: joins that were broadcast, cuts that were not kept, numbers taken for postcodes."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tallystone.functions import formulas, numbers, text
from tallystone.operators import audit, graph, linkage, related, report, retrieval, statements, terms
from tallystone.plans import catalogue
from tallystone.sources import paged


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broken_cells_are_merged_not_broadcast(spark):
    """cells exploded from a small table counted as small and were sent to the driver whole."""
    lines = [("opening", "opening"), ("moved", "movement"), ("closing", "closing")]
    cells = spark.range(50).select("id", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(k).alias("rk"), F.lit(c).alias("column"), F.lit(ck).alias("ck")) for r, k in lines for c, ck in (("a", "part"), ("b", "part"), ("sum", "total"))])).alias("c")).select("id", "c.*")
    value = F.when(F.col("rk") == "closing", 2).otherwise(1) * F.when(F.col("ck") == "total", 2).otherwise(1)
    off = ((F.col("id") % 2 == 0) & (F.col("row") == "moved") & (F.col("column") == "b")).cast("int") * 5
    cells = cells.withColumn("value", (value + off).cast("string"))
    found = audit.broken_cells(cells, audit.matrix_closure(cells, "id", "row", "column", "rk", "ck", "value"), "id", "row", "column", "rk", "ck")
    assert "Broadcast" not in plan(found)
    assert rows(found) == sorted([(i, "moved", "b", 5.0) for i in range(0, 50, 2)], key=str)


def test_prefixes_are_cut_at_lengths_of_names_only(spark):
    """every prefix of every name was made, and the names were broadcast."""
    names = ["abcdefgh", "abcdefghij", "abcdefghijkl", "abcdefgh", "abcdefg", "xyzxyzxyz", None, "资产负债表合并资产负债表"]
    found = linkage.prefixes(spark.createDataFrame(list(enumerate(names)), "id long, name string"), "id", "name")
    assert "BroadcastHashJoin" not in plan(found) and "BroadcastExchange" not in plan(found)
    assert "sequence(8" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == sorted([(1, 1, 0), (2, 2, 0)], key=str)


def test_many_pages_make_few_partitions(spark, tmp_path, monkeypatch):
    """every page was a partition, and every partition listed the whole folder."""
    (tmp_path / "part-1").mkdir()
    for p in range(900):
        (tmp_path / "part-1" / f"page-{p + 1}.json").write_text(json.dumps({"total": 1799, "rows": [{"id": i, "date": "2024-01-01"} for i in range(2 * p, min(1799, 2 * p + 2))]}))
    df = paged.listed(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= paged.PARTITIONS
    assert sorted(int(r.id) for r in df.select("id").collect()) == list(range(1799))
    reader = paged.PageReader(paged.FolderPages({"path": str(tmp_path)}), df.schema, {})
    parts = reader.partitions()
    monkeypatch.setattr(paged, "files_below", None)  # no task looks for files
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1799 and sum(len(p.places) for p in parts) == 900
    assert len(paged.PageStream(paged.FolderPages({"path": str(tmp_path / "part-1")}), df.schema).partitions({"n": 0}, {"n": 1799})) <= paged.PARTITIONS


def test_parts_held_in_texts_of_their_group(spark):
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("ab😀资") for _ in range(n))
    texts = [(g, made(rng.randint(0, 30))) for g in range(4) for _ in range(25)] + [(1, None), (9, "ab")]
    parts = [(g, made(rng.randint(0, 5))) for g in range(5) for _ in range(25)] + [(1, None), (1, texts[30][1])]
    found = terms.contained_within(spark.createDataFrame(texts, "g int, t string"), spark.createDataFrame(parts, "g int, p string"), "g", "t", "p")
    assert rows(found) == sorted({(g, t, p) for g, t in texts for h, p in parts if g == h and t and p and p in t}, key=str)


def test_references_and_names_stay_off_the_driver(spark):
    """all names and references were collected, and tables were broadcast."""
    data = [(r, 10 * r + i, n) for r in (1, 2) for i, n in enumerate(["附注1", "附注12的表", "", "附注1"])]
    tables = spark.createDataFrame(data, "report int, k long, name string").withColumn("rows", F.array(F.array(F.lit("资产总计"))))
    asked = spark.createDataFrame([(1, "附注1"), (1, "见附注1的说明"), (1, "12"), (1, "77"), (2, "附注12"), (2, "无")], "report int, ref string")
    found = statements.tables_by_reference(asked, tables, "report", "ref", "k", "k", "name", "rows")
    assert "Broadcast" not in plan(found)
    assert rows(found) == sorted([(1, "附注1", 10, "name"), (1, "见附注1的说明", 10, "name"), (1, "12", 12, "id"), (1, "77", None, None), (2, "附注12", 20, "name"), (2, "无", None, None)], key=str)


def test_cuts_of_lanes_are_kept(spark):
    """approximate quantiles were worked out twice, and may differ from one time to the next."""
    found = graph.lanes(spark.range(100).withColumn("lane", F.col("id") % 2), "lane", "id", rows_a_range=20)
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found.select("id", "lane_no", "row_no")) == sorted([(i, 1 + i % 2, 1 + i // 2) for i in range(100)], key=str)


def test_numbers_of_houses_are_no_postcodes(spark):
    """six digits before 号 or 室 were taken for a postcode."""
    data = {"北京市海淀区中关村大街100156号400624室": "北京海淀区中关村大街100156号400624室", "100083北京市海淀区中关村大街1号": "北京海淀区中关村大街1号", "中关村大街1号 100083": "中关村大街1号", "大街1234567号": "大街1234567号"}
    df = spark.createDataFrame([(k,) for k in data], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.normal_address(F.col("t"))).collect()} == data
    assert [r[0] for r in df.limit(1).select(related.building(F.col("t"))).collect()] == ["北京海淀区中关村大街100156号"]


def test_links_by_common_and_rare_values(spark):
    """F8: a value that most entities share was one task's; all other classes were broadcast."""
    marks = spark.range(300).select(F.col("id").alias("entity"), F.explode(F.array(F.struct(F.lit("person").alias("dimension"), F.lit("all").alias("value")), F.struct(F.lit("phone").alias("dimension"), F.floor(F.col("id") / 2).cast("string").alias("value")))).alias("m")).select("entity", "m.*")
    found = related.linked(marks.unionByName(marks), common=100)
    want = [(i, "person", "all", 0, 299, related.MEDIUM) for i in range(300)] + [(i, "phone", str(i // 2), i // 2 * 2, 1, related.HIGH) for i in range(300)]
    assert rows(found.select("entity", "dimension", "value", "class_id", "n_links", "level")) == sorted(want, key=str)
    assert rows(related.linked(marks)) == rows(found)
    tree = plan(found)
    assert "SortMergeJoin" in tree and "REPARTITION_BY_NUM" in tree


def test_investments_between_known_companies(spark):
    """its query now counts every trade between a supplier and a part."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "x"), ("x", "b"), ("b", "a"), (None, "a")], "parent string, child string")
    assert rows(related.investments(edges, spark.createDataFrame([("a",), ("b",), ("b",)], "name string"))) == [("a", "b"), ("b", "a")]
    sf = "/root/testdata/sf0.001"
    kept = catalogue.queries()["q81_investments"](spark, sf).agg(F.sum("n")).first()[0]
    assert kept == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()


def test_pieces_of_many_texts_come_in_parts(spark, monkeypatch):
    """the pieces of a whole batch of texts were held at once."""
    monkeypatch.setattr(retrieval, "CHUNK_CHARS", 3000)
    texts = [(i, ("word " * 40 + "end.\n\n") * i if i % 5 else None if i else "") for i in range(23)]
    pieces = retrieval.chunks(spark.createDataFrame(texts, "k long, t string").coalesce(1), "k", "t", "generic")
    assert rows(retrieval.reassembled(pieces, "k")) == sorted([(k, t) for k, t in texts if t], key=str)
    sizes = []
    monkeypatch.setattr(spark.createDataFrame([], "k long, t string").__class__, "mapInArrow", lambda df, f, schema: sizes.extend(b.num_rows for b in f([pa.RecordBatch.from_pylist([{"k": k, "t": t} for k, t in texts])])))
    retrieval.chunks(spark.createDataFrame(texts, "k long, t string"), "k", "t", "generic")
    assert len(sizes) > 5


def test_formulas_are_read_once(spark):
    """the formula and its value were worked out several times a row, and each operator's text was cast to a number."""
    df = spark.createDataFrame([("marked-2*(3+4)",), ("marked--2**2",), ("marked-1/0",), ("marked-2 3",), (None,)], "f string")
    found = df.select("f", formulas.evaluate(F.regexp_replace("f", "^marked-", "")).alias("v"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("marked-") == 1
    assert {r.f: r.v for r in found.collect()} == {"marked-2*(3+4)": 14.0, "marked--2**2": -4.0, "marked-1/0": None, "marked-2 3": None, None: None}


def test_roles_of_headers_are_told_once(spark):
    """every place of every relation told all headers' roles again, and every amount sought its place again."""
    df = spark.createDataFrame([(["项目", "期初数", "本期增加", "本期减少", "期末数"], ["x", "5", "约3元", "-", "8"]), (["甲"], ["1"])], "h array<string>, c array<string>")
    found = report.cross_foot_tables(df, "h", "c", chain=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("坏账准备|减值准备") == 1
    assert rows(found.select("pattern", "expected", "actual", "passed")) == sorted([("B", 8.0, 8.0, True), (None, None, None, None)], key=str)


def test_annotated_totals_shuffle_cells_once_a_note(spark):
    """q136 made its notes from all cells three times over and sorted every cell again to gather totals."""
    cells = spark.createDataFrame([(1, r, c, t) for r, c, t in ((1, 1, "5"), (2, 1, "7"), (3, 1, "2"), (9, 1, "10"), (8, 1, "—"), (1, 2, "9"), (9, 2, "9"), (9, 3, "4"), (7, 1, "10.5"))], "k int, r int, c int, t string")
    rows = spark.createDataFrame([(1, 1, "detail", "+", False), (1, 2, "detail", "+", False), (1, 3, "detail", "-", None), (1, 9, "total", "+", False), (1, 8, "小计", "+", False), (1, 7, "sum", "+", False)], "k int, r int, kind string, op string, is_subitem boolean")
    columns = spark.createDataFrame([(1, 1, "amount"), (1, 2, "percentage"), (1, 3, "amount")], "k int, c int, kind string")
    found = report.annotated_foot(cells, rows, columns, "k", "r", "c", "t")
    assert {(x.k, x.r, x.c, x.footed, x.total, x.passed) for x in found.collect()} == {(1, 9, 1, 10.0, 10.0, True), (1, 7, 1, 10.0, 10.5, False)}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = catalogue.queries()["q136_annotated_totals"](spark, "/root/testdata/sf0.001")
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 5


def test_cells_looked_up_by_one_match_where_they_are_plain(spark):
    """q90 stripped, matched and cut every cell five times over, also plain amounts and labels without a digit."""
    odd = ["", "-", "—", " 12 ", "12\n", "1,234.50", "-7", "-1,000", "(5)", "（5）", "(1,234.5)", "abc", "营业收入", "约3,000元", "1.2.3", "5.", ".5", "12%", "１２", "1,23", "--4", "　8　", "(x)", None, "9" * 400]
    rng = random.Random(4)
    odd += ["".join(rng.choice("0123456789,.-() 万\n—") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    texts = spark.createDataFrame([(t,) for t in odd], "t string")
    both = texts.select("t", numbers.table_number(F.col("t")).alias("a"), numbers._looked_up(F.col("t")).alias("b")).collect()
    assert [r for r in both if r.a != r.b] == []
    assert numbers.SIMPLE in texts.select(numbers.table_number(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_tables_to_foot_are_made_once(spark):
    """q135 made every table again for each currency and each word of a statement, and read its headers cell by cell."""
    cell = F.concat(F.lit("marked-"), F.col("id").cast("string"))
    texts = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    rows_ = F.array(texts("类别", cell, "占比"), texts("甲", "1", "5"), texts("减：乙", "0.5", "5"), texts(F.when(F.col("id") == 1, "净利润").when(F.col("id") == 2, "美元日元").otherwise("丙"), "2"), texts("合计", "2.5", "9"))
    tables = spark.range(4).select("id", texts("项目", "本年", "").alias("h"), rows_.alias("r"))
    found = report.foot_matrices(tables, "id", "h", "r")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("marked-") == 1 and plan.count("百分比") == 1
    assert rows(found.select("id", "col", "footed", "total", "passed")) == [(0, 1, 2.5, 2.5, True), (3, 1, 2.5, 2.5, True)]
