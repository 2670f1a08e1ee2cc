"""Answers to the tasks that wrote a saved table: packed by task, read by the next pass over it.

A row is (__t, blob), __t the number of the task that it is for. Tasks next to each
other share a folder where there are more than FOLDERS of them; within it rows
stand in order of their tasks, so that a reader takes its row groups only.
"""

from __future__ import annotations

import uuid

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import shared_root, uri

FOLDERS = 4096


def packed(rows: DataFrame, tasks: int, name: str) -> str:
    """Path of ``rows`` (__t, blob), by folders. Numbers below 0 lie with task 0."""
    each = -(-tasks // FOLDERS)
    path = f"{shared_root(rows.sparkSession)}/{name}-{uuid.uuid4().hex}-{each}"
    folder = F.floor(F.greatest("__t", F.lit(0)) / each).cast("int")
    dealt = rows.withColumn("__f", folder).repartitionById(-(-tasks // each), F.col("__f")).sortWithinPartitions("__f", "__t")
    dealt.write.option("parquet.block.size", 1 << 20).partitionBy("__f").parquet(path)
    return path


class Replies:
    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri(path))
        self.each = int(path.rsplit("-", 1)[1])

    def blobs(self, number: int) -> list[bytes]:
        """What one task is told."""
        folder = pafs.FileSelector(f"{self.root}/__f={number // self.each}", allow_not_found=True)
        out: list[bytes] = []
        for f in self.fs.get_file_info(folder):
            if f.path.endswith(".parquet"):
                with self.fs.open_input_file(f.path) as source:
                    out += pq.read_table(source, columns=["blob"], filters=[("__t", "=", number)]).column("blob").to_pylist()
        return out
