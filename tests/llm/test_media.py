import hashlib
import io
import tarfile
import zlib

from pyspark.sql import functions as F

from tallystone.llm import media
from tallystone.llm.common import uri
from tallystone.llm.queries import op10_media_columns
from tests.llm.fixtures import ROWS, awkward, empty

SF = "/root/testdata/sf0.001"


def payload(text):
    raw = (text or "").encode()
    size = max(64, -(-len(raw) // 64) * 64)
    return raw + bytes(size - len(raw)), len(raw)


def hold(rows, docs):
    assert len(rows) == len(docs)
    for r in rows:
        want, n = payload(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_query(spark):
    hold(op10_media_columns(spark, SF).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()})


def test_awkward(spark):
    docs = {r[0]: r[1] for r in ROWS}
    rows = media.report(awkward(spark)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.payload_sha256 == hashlib.sha256(payload(docs[r.doc_id])[0]).hexdigest()
    assert media.report(empty(spark)).count() == 0


def members(root):
    names = []
    for path in root.glob("*.tar"):
        with tarfile.open(path) as tar:
            names += tar.getnames()
    return names


def test_equal_payloads_of_all_tasks_are_stored_once(spark, tmp_path):
    texts = ["same"] * 40 + [f"text {i % 25}" for i in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    df.repartition(6).write.parquet(f"{tmp_path}/documents")
    df = spark.read.option("maxPartitionBytes", "1").parquet(f"{tmp_path}/documents")
    manifest = media.store(df, uri(str(tmp_path)))
    names = members(tmp_path)
    assert len(names) == len(set(names)) == 27
    out = media.with_features(media.with_headers(manifest, uri(str(tmp_path))), uri(str(tmp_path)))
    assert out.count() == len(texts) and out.columns[:2] == ["doc_id", "part"]
    for r in out.collect():
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload(texts[r.doc_id])[0]).hexdigest() and r.width == 64


def test_payloads_left_to_a_task_that_has_none(spark, tmp_path, monkeypatch):
    """Told to leave everything, tasks store nothing; a further pass stores it all."""
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(media, "left_to_others", lambda rows, tasks: media.packed(rows.select(F.col("part").alias("__t"), F.col("digest").alias("blob")), tasks, "all"))
    assert media.store(df, uri(str(tmp_path))).where("shard is not null").count() == 20


def test_shards_are_tar_files(spark, tmp_path):
    writer = media.ShardWriter(uri(str(tmp_path)), limit=2000)
    placed = {}
    for i in range(40):
        data, _ = payload(f"text {i % 30} " * (i % 30))
        digest = hashlib.sha256(data).hexdigest()
        placed[digest] = (*writer.add(digest, data), data)
    writer.close()
    found = {}
    for path in tmp_path.glob("*.tar"):
        with tarfile.open(path) as tar:
            for member in tar:
                found.setdefault(member.name.removesuffix(".png"), []).append(tar.extractfile(member).read())
    assert set(found) == set(placed) and len(list(tmp_path.glob("*.tar"))) > 1
    reader = media.ShardReader(uri(str(tmp_path)))
    for digest, (shard, offset, length, data) in placed.items():
        body = reader.read(shard, offset, length)
        assert body in found[digest] and media.from_png(body) == data
        assert media.header_of(reader.read(shard, offset, 33)) == (64, len(data) // 64, 8)
    assert io.BytesIO(body)
