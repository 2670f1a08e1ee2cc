"""A data sink of whole files: one file a row, none visible before all are written.

``df.write.format("files").mode("append" or "overwrite").save(folder)`` after
``register(spark)``, for rows (name, content) with content as binary or text. Every
task writes into a folder of its own under ``_pending``; the commit moves the tasks'
folders into place, the driver handling one name a task. Task attempts that failed
or came second are never moved; an abort removes what was written, and what a task
that is stopped late still writes stays hidden. Names may hold folders; two rows with one name both stay, in their tasks' folders.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tallystone.sources.folders import opened


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _pending(self) -> tuple[fs.FileSystem, str, str]:
        system, inner, _ = opened(self.path)
        return system, inner, f"{inner}/_pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, pending = self._pending()
        task, n, made = uuid.uuid4().hex, 0, set()
        for row in iterator:
            name = re.sub(r"(^|/)\.+(?=/|$)", r"\1_", row["name"].lstrip("/"))
            place = f"{pending}/part-{task}/{name}"
            folder = place.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            value = row["content"]
            with system.open_output_stream(place) as f:
                f.write(value.encode() if isinstance(value, str) else bytes(value))
            n += 1
        return Written(f"part-{task}", n)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner, pending = self._pending()
        before = [f.path for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.base_name != pending.rsplit("/", 1)[-1]]
        system.create_dir(inner, recursive=True)
        for m in messages:
            if m is not None and m.files:
                system.move(f"{pending}/{m.folder}", f"{inner}/{m.folder}")
        if self.overwrite:
            for old in before:
                if system.get_file_info(old).type == fs.FileType.Directory:
                    system.delete_dir(old)
                else:
                    system.delete_file(old)
        self._drop(system, pending)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, pending = self._pending()
        self._drop(system, pending)

    @staticmethod
    def _drop(system: fs.FileSystem, pending: str) -> None:
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (name, content) as files below ``path``."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(Files)
    rows.select("name", rows["content"].cast("binary").alias("content")).write.format("files").mode(mode).save(path)
