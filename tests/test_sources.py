"""Data sources and sinks of whole files: documents, pages, workbooks, diagrams."""

import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tallystone.operators import graph
from tallystone.sinks import diagrams, files, workbooks
from tallystone.sources import folders, library, office, paged


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


WORD = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>第一段</w:t><w:br/><w:t>续</w:t></w:r></w:p><w:p/><w:sdt><w:sdtContent><w:p><w:r><w:t>控件里的</w:t></w:r><w:r><w:tab/><w:t>字</w:t></w:r></w:p>'
    "<w:sdt><w:sdtContent><w:p><w:ins><w:r><w:t>内层</w:t></w:r></w:ins></w:p></w:sdtContent></w:sdt></w:sdtContent></w:sdt><w:tbl><w:tr><w:tc><w:p><w:r><w:t>表格</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:t>尾</w:t></w:r><w:r><w:txbxContent><w:p><w:r><w:t>框</w:t></w:r></w:p></w:txbxContent></w:r></w:p></w:body></w:document>"
)


def word_file(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)


@pytest.fixture
def library_of_files(tmp_path):
    (tmp_path / "a.md").write_text("# 标题\r\n正文", newline="")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.TXT").write_bytes("甲".encode() + b"\xff" + "乙".encode())
    word_file(tmp_path / "c.docx", WORD)
    word_file(tmp_path / "boxes.docx", WORD.replace("第一段", " ").replace("续", "").replace("控件里的", "").replace("字", "").replace("内层", "").replace("尾", ""))
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "f.csv").write_text("x")
    (tmp_path / ".hidden.md").write_text("x")
    return tmp_path


def test_documents_of_every_kind(spark, library_of_files):
    got = {r.path.rsplit("/", 1)[1]: (r.extension, r.text, r.error) for r in library.read_documents(spark, str(library_of_files)).collect()}
    assert set(got) == {"a.md", "b.TXT", "c.docx", "boxes.docx", "d.docx", "e.pdf", "blank.txt"}
    assert got["a.md"] == ("md", "# 标题\n正文", None) and got["b.TXT"] == ("txt", "甲乙", None)
    assert got["c.docx"][1] == "第一段\n续\n控件里的\t字\n内层\n尾"
    assert got["boxes.docx"][1] == "表格\n框"
    assert got["d.docx"][2].startswith("BadZipFile") and got["e.pdf"][2] == "NoText: no reader for pdf files" and got["blank.txt"][2] == "NoText: no text in the file"
    summary = library.ingest_summary(library.read_documents(spark, str(library_of_files))).first()
    assert (summary.n_files, summary.n_read, summary.n_errors) == (7, 4, 3)


def test_filters_reach_the_list_of_files(library_of_files):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

    reader = library.Reader({"path": str(library_of_files)})
    left = list(reader.pushFilters([In(("extension",), ["md", "txt"]), StringContains(("path",), "sub"), GreaterThan(("length",), 3), IsNotNull(("text",)), EqualTo(("text",), "x")]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    assert [f.path.rsplit("/", 1)[1] for p in reader.partitions() for f in p.files] == ["b.TXT"]


def test_partitions_by_size(spark, tmp_path):
    for i, n in enumerate([10, 9000, 9000, 30_000, 5]):
        (tmp_path / f"{i}.md").write_text("x" * n)
    reader = library.Reader({"path": str(tmp_path), "partition_bytes": "20000"})
    assert [[f.path[-4] for f in p.files] for p in reader.partitions()] == [["0", "1"], ["2"], ["3"], ["4"]]
    df = library.read_documents(spark, str(tmp_path), partition_bytes="20000").where("extension = 'md' and length > 9000")
    assert df.count() == 1 and df.rdd.getNumPartitions() == 1
    assert library.read_documents(spark, str(tmp_path), extensions="docx").count() == 0


def test_results_are_loaded_tolerantly(spark):
    good = {"meta": {"company": "甲", "n": 1}, "results": [{"result_id": "1", "severity": "error", "passed": False, "confidence": 0.5, "page": 3}, {"passed": "odd"}]}
    texts = [("a", json.dumps(good)), ("b", "{}"), ("c", '{"meta": [], "results": {}}'), ("d", "[1]"), ("e", "no json"), ("f", '{"results": [5, {"severity": "info"}]}'), ("g", None)]
    found, problems = library.load_results(spark.createDataFrame(texts, "path string, text string"))
    got = rows(found.select("path", "meta", "result_id", "severity", "passed", "confidence", "page"))
    assert got == sorted([("a", {"company": "甲", "n": "1"}, "1", "error", False, 0.5, "3"), ("a", {"company": "甲", "n": "1"}, None, None, None, None, None), ("f", {}, None, None, None, None, None), ("f", {}, None, "info", None, None, None)], key=str)
    assert rows(problems) == [("d", "no object"), ("e", "no JSON"), ("g", "no JSON")]


def pages(folder, records, size):
    """Writes records, newest first, as pages."""
    folder.mkdir(exist_ok=True)
    for p in range(-(-len(records) // size)):
        (folder / f"page-{p + 1}.json").write_text(json.dumps({"total": len(records), "rows": records[p * size : (p + 1) * size]}))


def record(i):
    return {"id": i, "title": f"法{i}", "date": f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", "status": None if i % 3 else "有效"}


def test_pages_behind_a_date_are_not_read(spark, tmp_path):
    records = [record(i) for i in range(99, -1, -1)]
    pages(tmp_path / "p", records, 10)
    everything = paged.listed(spark, str(tmp_path / "p"))
    assert everything.rdd.getNumPartitions() == 10 and everything.count() == 100
    for since in ("2024-03-05", records[0]["date"], records[-1]["date"], "2025-01-01", "2023-01-01"):
        df = paged.listed(spark, str(tmp_path / "p"), since)
        want = sorted(str(r["id"]) for r in records if r["date"] >= since)
        assert sorted(r.id for r in df.collect()) == want
        assert df.rdd.getNumPartitions() == max(1, -(-len(want) // 10))
    # What lies behind the last page wanted is never opened.
    for p in range(6, 11):
        (tmp_path / "p" / f"page-{p}.json").write_text("broken")
    reader = paged.PageReader(paged.FolderPages({"path": str(tmp_path / "p")}), everything.schema, {"max_pages": "5"})
    assert [p.number for p in reader.partitions()] == [1, 2, 3, 4, 5]


def test_equal_dates_over_several_pages(spark, tmp_path):
    records = [{"id": i, "date": "2024-02-02"} for i in range(25)] + [{"id": 25, "date": "2024-02-01"}, {"id": 26}]
    pages(tmp_path / "p", records, 10)
    assert paged.listed(spark, str(tmp_path / "p"), "2024-02-02").count() == 25
    assert paged.listed(spark, str(tmp_path / "p"), "2024-02-01").count() == 26
    assert paged.listed(spark, str(tmp_path / "p")).where("status is null and title is null").count() == 27


def test_a_stream_goes_on_from_the_last_run(spark, tmp_path):
    source, target, checkpoint = tmp_path / "p", str(tmp_path / "out"), str(tmp_path / "check")
    for n in (7, 7, 30, 31):
        pages(source, [record(i) for i in range(n - 1, -1, -1)], 10)
        paged.follow(spark, str(source), target, checkpoint).awaitTermination()
        assert sorted(int(r.id) for r in spark.read.parquet(target).collect()) == list(range(n))


def test_records_that_arrive_between_planning_and_reading():
    class Listed:
        def __init__(self, n):
            self.n = n

        def fetch(self, page):
            ids = list(range(self.n - 1, -1, -1))
            return {"total": self.n, "rows": [{"id": i} for i in ids[(page - 1) * 10 : page * 10]]}

    from pyspark.sql.types import StructType

    service = Listed(25)
    stream = paged.PageStream(service, StructType().add("id", "string"))
    parts = stream.partitions({"n": 8}, {"n": 25})
    service.n = 39
    assert sorted(int(r[0]) for p in parts for r in stream.read(p)) == list(range(8, 25))
    assert stream.partitions({"n": 25}, {"n": 25}) == [paged.Span(0, 0)]


def test_one_list_that_fails_leaves_the_other(spark, tmp_path):
    pages(tmp_path / "p", [record(i) for i in range(5)], 10)
    found, errors = paged.from_sources(spark, {"a": str(tmp_path / "p"), "b": str(tmp_path / "none")})
    assert found.count() == 5 and {r.source for r in found.collect()} == {"a"} and set(errors) == {"b"}
    found, errors = paged.from_sources(spark, {"b": str(tmp_path / "none")})
    assert found.count() == 0 and set(errors) == {"b"}


def names(path):
    return sorted(f.path.split("/part-", 1)[1].split("/", 1)[1] for f in folders.files_below(str(path)))


def test_files_appear_when_all_are_written(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.range(20).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("content")).repartition(4)
    files.write_files(df, str(out))
    assert names(out) == sorted(f"d/{i}.txt" for i in range(20))
    files.write_files(df.limit(2), str(out), "append")
    assert len(names(out)) == 22
    files.write_files(df.limit(3), str(out), "overwrite")
    assert len(names(out)) == 3
    broken = df.withColumn("content", F.when(F.col("name") == "d/7.txt", F.raise_error("stop")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        files.write_files(broken, str(out), "overwrite")
    assert len(names(out)) == 3  # a task that is stopped late may leave a folder, which no reader sees


def test_names_stay_below_the_folder(spark, tmp_path):
    df = spark.createDataFrame([("../../up.txt", "x"), ("/abs.txt", "y")], "name string, content string")
    files.write_files(df, str(tmp_path / "out"))
    assert len(list(tmp_path.rglob("*.txt"))) == 2 and not (tmp_path / "up.txt").exists()


def test_workbooks_are_read_back(spark, tmp_path):
    data = [("甲公司", "竖加", 2, "x\x01<&>", 1.5, True), ("甲公司", "竖加", 1, " 空 ", None, False), ("甲公司", "别的[1]", 3, None, 2.0, None), (None, "横加", 1, "y", 0.1, True)]
    df = spark.createDataFrame(data, "k string, s string, o int, t string, v double, b boolean")
    made = workbooks.workbooks(df, "k", F.col("s"), "o", ["o", "t", "v", "b"], ["横加", "竖加"])
    files.write_files(made, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("*.xlsx"))) == 2
    book = next((tmp_path / "out").rglob("甲公司.xlsx")).read_bytes()
    sheets = {}
    for sheet, _, cells in office.xlsx_rows(book):
        sheets.setdefault(sheet, []).append(cells)
    assert list(sheets) == ["汇总", "横加", "竖加", "别的_1_"]
    assert sheets["汇总"] == [["汇总", "n"], ["横加", "0"], ["竖加", "2"], ["别的[1]", "1"]]
    assert sheets["竖加"] == [["o", "t", "v", "b"], ["1", " 空 ", "", "0"], ["2", "x<&>", "1.5", "1"]]
    assert workbooks.workbook([("a", [["x"]])]) == workbooks.workbook([("a", [["x"]])])
    assert workbooks.sheet_names(["a" * 40, "a" * 40, "", "A/b", "a_B"]) == ["a" * 31, "a" * 29 + "_2", "Sheet", "A_b", "a_B_2"]
    assert [workbooks.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def rows_by_scan(lanes, before):
    """Every node looks at every lane between."""
    rows, row, taken = {}, 0, []
    for i, lane in enumerate(lanes):
        clash = lane in taken
        for p in before[i]:
            if not clash and rows.get(p) == row:
                low, high = sorted((lanes[p], lane))
                clash = any(between in taken for between in range(low + 1, high))
        if clash:
            row, taken = row + 1, []
        rows[i] = row
        taken.append(lane)
    return [rows[i] for i in range(len(lanes))]


def test_rows_avoid_taken_lanes():
    import random

    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(0, 25)
        lanes = [rng.randint(0, 5) for _ in range(n)]
        before = [[rng.randrange(n) for _ in range(rng.randint(0, 3))] for _ in range(n)]
        assert graph.place_rows(lanes, before) == rows_by_scan(lanes, before)


def test_layout_and_drawing(spark, tmp_path):
    data = [
        ("p", 1, "a", "申请<&>", "销售", None, "process", ""), ("p", 2, "b", "审批", "财务", [("c", "否"), ("d", "是")], "decision", ""), ("p", 3, "c", "退回", "销售", [], "process", "单据"), ("p", 4, "d", "付款", "出纳 ", [], "process", "nan"),
        ("q", 1, "x", None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "d string, o int, id string, label string, lane string, t array<struct<id:string,condition:string>>, kind string, docs string")
    flat = df.withColumn("t", F.transform("t", lambda x: x["id"]))
    got = rows(graph.layout(flat, "d", "o", "id", "lane", "t", "kind", "docs").select("d", "o", "lane_no", "row_no", "x", "y", "height"))
    # c goes back to a taken lane, so a row begins; d fits beside it.
    assert got == [("p", 1, 0, 0, 120, 220, 70), ("p", 2, 1, 0, 400, 220, 60), ("p", 3, 0, 1, 120, 390, 110), ("p", 4, 2, 1, 680, 390, 70), ("q", 1, 0, 0, 120, 220, 70)]
    files.write_files(diagrams.drawings(df, "d", "o", "id", "label", "lane", "t", "kind", "docs"), str(tmp_path / "out"))
    root = ElementTree.parse(next((tmp_path / "out").rglob("p.drawio"))).getroot()
    cells = {c.get("id"): c for c in root.iter("mxCell")}
    assert cells["node-a"].get("value") == "申请<&>" and [cells[f"lane-{i}"].get("value") for i in range(3)] == ["销售", "财务", "出纳"]
    edges = {(c.get("source"), c.get("target")): c for c in cells.values() if c.get("edge")}
    assert set(edges) == {("start", "node-a"), ("node-d", "end"), ("node-a", "node-b"), ("node-b", "node-c"), ("node-b", "node-d")}
    assert "dashed=1" in edges["node-b", "node-c"].get("style") and "dashed=1" not in edges["node-b", "node-d"].get("style")
