"""A cache of what was found out about tables, kept by their content.

Rows are (hash, annotation). A version is a folder that is written whole before a
small file ``CURRENT`` names it, and that file is replaced at once; readers follow
it and see the version before or the one after. The two last versions stay, so
that a reader that has just looked still finds its files. A cache is of one model:
under another model's name it is empty.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.sources.folders import opened

KEPT_VERSIONS = 2
SCHEMA = "hash string, annotation string"


def table_hash(source_file: Column, name: Column, chapter: Column, headers: Column, rows: Column) -> Column:
    """First 32 hex digits of the SHA-256 of a table's content as JSON with its keys in order; a missing field counts as empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    content = F.struct(
        empty(chapter).alias("chapter"), F.coalesce(headers, F.array().cast("array<string>")).alias("headers"), empty(name).alias("name"),
        F.coalesce(rows, F.array().cast("array<array<string>>")).alias("rows"), empty(source_file).alias("source_file"),
    )
    return F.substring(F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256), 1, 32)


def _pointer(root: str) -> dict:
    system, inner, _ = opened(root)
    try:
        with system.open_input_stream(f"{inner}/CURRENT") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {"model": None, "versions": []}


def read(spark: SparkSession, root: str, model: str) -> DataFrame:
    """(hash, annotation) of the current version; none under another model's name."""
    now = _pointer(root)
    if now["model"] != model or not now["versions"]:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{root}/{now['versions'][-1]}")


def missing(tables: DataFrame, cached: DataFrame, key: str = "hash") -> DataFrame:
    """Tables whose content the cache does not know, one of each content."""
    return tables.join(cached.select(key), key, "left_anti").dropDuplicates([key])


def write(spark: SparkSession, root: str, model: str, found: DataFrame) -> str:
    """Add (hash, annotation) to the cache as a new version and name it the current one; what is new wins. Returns its name.

    Versions that neither of the last two readers may see are removed.
    """
    now = _pointer(root)
    old = read(spark, root, model)
    version = f"version-{uuid.uuid4().hex}"
    fresh = found.select("hash", F.col("annotation").cast("string").alias("annotation")).groupBy("hash").agg(F.max("annotation").alias("annotation"))
    old.join(fresh.select("hash"), "hash", "left_anti").unionByName(fresh).write.parquet(f"{root}/{version}")
    system, inner, _ = opened(root)
    versions = ([*now["versions"], version] if now["model"] == model else [version])[-KEPT_VERSIONS:]
    with system.open_output_stream(f"{inner}/CURRENT-{version}") as f:
        f.write(json.dumps({"model": model, "versions": versions}).encode())
    system.move(f"{inner}/CURRENT-{version}", f"{inner}/CURRENT")
    for gone in system.get_file_info(fs.FileSelector(inner)):
        if gone.base_name.startswith("version-") and gone.base_name not in versions and gone.base_name in now["versions"]:
            system.delete_dir(gone.path)
    return version


def annotated(tables: DataFrame, cached: DataFrame, table: str, key: str = "hash") -> DataFrame:
    """(table, annotation) of the tables whose content the cache knows."""
    return tables.select(table, key).join(cached, key).select(table, "annotation")
