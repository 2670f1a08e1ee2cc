"""Media columns: content-addressed payloads in tar shards on the shared folder.

A text's payload is its UTF-8 bytes and then zero bytes up to a positive
multiple of 64. It is stored without loss as the 8-bit samples of a grayscale
PNG, 64 samples a row, in tar shards whose member names are the payload's
SHA-256. A row carries digest, shard, offset and length. Every payload is stored
once: digests are counted first, and of the tasks that hold one, the first stores
it, the others are told to leave it. Header-only range reads (the 33 bytes of
signature and IHDR) fill the metadata columns, and whole members are read back by
offset, once a payload however many rows share it.

A shard has a name of its own for every task attempt, and rows name the shard
they were written to, so a lost or repeated attempt leaves at most an unnamed
file. Digests and places are saved tables, which fixes what later steps read. Should
the input's partitions differ between the two passes over it, payloads that nobody
stored are stored in a third.

Defined cases: null and empty texts store 64 zero bytes; equal texts have equal
values in all columns; empty tables give no rows; very long texts are one payload
each; columns named as results are replaced, others are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import fresh, salted_join, saved, shared_root, slices, without
from tallystone.llm.replies import Replies, packed

UNIT = 64
SHARD_BYTES = 128 << 20
READ_BYTES = 32 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
ENTRY = T.StructType().add("n_bytes", "long").add("payload_bytes", "long").add("digest", "string").add("shard", "string").add("offset", "long").add("length", "long")
PLACE = T.StructType(ENTRY.fields[3:])


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def _piece(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _piece(b"IHDR", head) + _piece(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _piece(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        raise ValueError("not the header of a stored payload")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    width, height, _ = header_of(media[:HEADER_BYTES])
    at, parts = HEADER_BYTES, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            parts.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def tar_entry(name: str, body: bytes) -> bytes:
    """A ustar member: header block, then the body padded to 512 bytes."""
    head = struct.pack("100s8s8s8s12s12s8s1s100s6s2s32s32s8s8s155s12x", name.encode(), b"0000644", b"0000000", b"0000000", b"%011o" % len(body), b"00000000000", b" " * 8, b"0", b"", b"ustar", b"00", b"", b"", b"", b"", b"")
    head = head[:148] + b"%06o\0 " % sum(head) + head[156:]
    return head + body + bytes(-len(body) % 512)


class ShardWriter:
    """Appends members to tar shards of bounded size."""

    def __init__(self, root: str, limit: int = SHARD_BYTES):
        self.fs, self.folder = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(self.folder, recursive=True)
        self.root, self.limit, self.out, self.at = root, limit, None, 0
        self.stem = f"{TaskContext.get().partitionId() if TaskContext.get() else 0:06d}-{uuid.uuid4().hex}"
        self.count = 0

    def add(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at > self.limit:
            self.close()
        if self.out is None:
            self.name, self.at = f"{self.stem}-{self.count}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.count += 1
        media = to_png(payload)
        entry = tar_entry(f"{digest}.png", media)
        self.out.write(entry)
        place = self.name, self.at + 512, len(media)
        self.at += len(entry)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _numbered(documents: DataFrame, text: str) -> DataFrame:
    return documents.select(F.spark_partition_id().alias("part"), F.col(f"`{text}`").alias("text"))


def left_to_others(rows: DataFrame, tasks: int) -> str:
    """Path of the digests that each task leaves to one before it."""
    before = Window.partitionBy("digest").orderBy("part")  # a row a task
    others = rows.where("new").select("digest", "part", F.row_number().over(before).alias("k")).where("k > 1")
    return packed(others.select(F.col("part").alias("__t"), F.col("digest").alias("blob")), tasks, "media-left")


def places(documents: DataFrame, root: str, text: str, left: str | None) -> DataFrame:
    """(digest, shard, offset, length) of what the tasks store: each of their payloads but those left to others.

    The table's files follow the shards and their offsets.
    """

    def run(batches):
        writer, done, folder = ShardWriter(root), None, Replies(left) if left else None
        try:
            for batch in batches:
                if done is None and len(batch):
                    done = set(folder.blobs(batch.column("part")[0].as_py())) if folder else set()
                rows: list[tuple] = []
                for _, texts in slices(batch.column("text")):
                    for t in texts:
                        payload, _ = payload_of(t)
                        digest = hashlib.sha256(payload).digest()
                        if digest not in done:
                            done.add(digest)
                            rows.append((digest, *writer.add(digest.hex(), payload)))
                kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["digest", *PLACE.names])
        finally:
            writer.close()

    return saved(_numbered(documents, text).mapInArrow(run, T.StructType([T.StructField("digest", T.BinaryType()), *PLACE.fields])), "media-places")


def stored(documents: DataFrame, root: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write every distinct payload of the texts below ``root``.

    Rows (row, n_bytes, payload_bytes, digest, at), ``row`` the columns but the
    text and ``at`` a number of their own, and members (digest, shard, offset, length).
    """
    kept = [c for c in documents.columns if c != text]
    row, known = T.StructType([documents.schema[c] for c in kept]), ["n_bytes", "payload_bytes", "digest", "new", "part"]
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.spark_partition_id().alias("part"), F.col(f"`{text}`").alias("text"))

    def digests(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[tuple] = []
            for _, texts in slices(batch.column("text")):
                for t in texts:
                    payload, n = payload_of(t)
                    digest = hashlib.sha256(payload).digest()
                    rows.append((n, len(payload), digest, digest not in seen))
                    seen.add(digest)
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new, batch.column("part")], ["row", *known])

    schema = T.StructType([T.StructField("row", row), *ENTRY.fields[:2], T.StructField("digest", T.BinaryType()), T.StructField("new", T.BooleanType()), T.StructField("part", T.IntegerType())])
    rows = saved(whole.mapInArrow(digests, schema), "media-digests")
    tasks = (rows.agg(F.max("part")).first()[0] or 0) + 1
    found = places(documents, root, text, left_to_others(rows, tasks))
    several = lambda df: df.select("digest").distinct().count()
    if not found.count() == several(found) == several(rows.where("new")):  # the input came in other partitions
        if rows.where("new").join(found, "digest", "left_anti").limit(1).count():
            found = found.unionByName(places(documents, root, text, None))
        found = saved(found.groupBy("digest").agg(F.min(F.struct(*PLACE.names)).alias("at")).select("digest", "at.*"), "media-places")
    return rows.drop("new", "part").withColumn("at", F.monotonically_increasing_id()), found


def store(documents: DataFrame, root: str, text: str = "text") -> DataFrame:
    """Write the texts' payloads below ``root``; the documents without text, with their entries.

    Columns named as the entry's fields are replaced.
    """
    rows, found = stored(without(documents, ENTRY.names), root, text)
    # Equal texts may be any share of the rows; they are spread by what tells rows apart.
    out = salted_join(rows, found, "digest", "at").withColumn("digest", F.lower(F.hex("digest")))
    return saved(out.select("row.*", *ENTRY.names), "media-manifest")


class ShardReader:
    def __init__(self, root: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(root)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.file = self.fs.open_input_file(f"{self.folder}/{shard}")
            self.name = shard
        got = self.file.read_at(length, offset)
        if len(got) != length:
            raise OSError(f"{shard} ends inside a member")
        return got


def read_back(members: DataFrame, root: str, fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """``digest`` and what ``make`` reads of each member."""
    schema = T.StructType([members.schema["digest"], *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches):
        reader = ShardReader(root)
        for batch in batches:
            rows = [make(reader, *at) for at in zip(*[batch.column(c).to_pylist() for c in PLACE.names], strict=True)]
            new = [pa.array([r[i] for r in rows], k) for i, (_, _, k) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *new], schema.names)

    return members.mapInArrow(run, schema)


def _by_member(manifest: DataFrame, root: str, fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """Append what ``make`` reads of each row's member; members are read once each, in ranges of location of about READ_BYTES."""
    base = without(manifest, [n for n, _, _ in fields])
    members = base.groupBy("digest").agg(F.min(F.struct(*PLACE.names)).alias("at")).select("digest", "at.*")
    parts = max(1, -(-(members.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    members = members.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    spread = fresh(base, "__spread")
    out = salted_join(base.withColumn(spread, F.monotonically_increasing_id()), read_back(members, root, fields, make), "digest", spread)
    return out.select(*[F.col(f"`{c}`") for c in base.columns], *[n for n, _, _ in fields])


HEADER = [(n, T.LongType(), pa.int64()) for n in ("width", "height", "depth")]
FEATURES = [("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]


def header_at(reader: ShardReader, shard: str, offset: int, _: int) -> tuple[int, int, int]:
    return header_of(reader.read(shard, offset, HEADER_BYTES))


def with_headers(manifest: DataFrame, root: str) -> DataFrame:
    """Append width, height and depth by range reads of 33 bytes of each member."""
    return _by_member(manifest, root, HEADER, header_at)


def features_of(media: bytes) -> tuple[str, int, int, str, str]:
    payload = from_png(media)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float(counts @ np.arange(256)) / len(payload)
    feature = f"mean={mean:.3f};distinct={len(share)};entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


def with_features(manifest: DataFrame, root: str) -> DataFrame:
    """Read every member back whole and append what its payload and stored form give."""
    return _by_member(manifest, root, FEATURES, lambda reader, *at: features_of(reader.read(*at)))


def report(documents: DataFrame) -> DataFrame:
    """The digest columns of every document's payload, after a round trip through the shards."""
    root = f"{shared_root(documents.sparkSession)}/media-{uuid.uuid4().hex}"
    if "://" not in root:
        root = f"file:{root}" if root.startswith("//") else f"file://{root.removeprefix('file:')}"
    rows, members = stored(documents.select("doc_id", "text"), root)
    read = read_back(members, root, [*HEADER, *FEATURES], lambda reader, *at: (*header_at(reader, *at), *features_of(reader.read(*at))))
    out = salted_join(rows, read, "digest", "at")
    return out.select("row.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(";", F.concat(F.lit("size="), "width", F.lit("x"), "height", F.lit("x"), "depth"), "feature").alias("feature"))
