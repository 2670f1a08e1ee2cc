"""Chunks with vectors, kept by project as Parquet partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new rows and the old ones whose id is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(spark: SparkSession, root: str, project: str, chunks: DataFrame, version: int) -> None:
    """Write one project's chunks as a new version, which readers see when it is whole."""
    chunks.write.mode("errorifexists").parquet(f"{root}/project={project}/version={version}")


def read_project(spark: SparkSession, root: str, project: str) -> DataFrame:
    """The last version of a project's chunks; KeyError if there is no such project."""
    try:
        rows = spark.read.option("basePath", f"{root}/project={project}").parquet(f"{root}/project={project}")
    except AnalysisException as e:
        raise KeyError(f"no project {project}") from e
    last = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == last).drop("version")


def counts(chunks: DataFrame) -> DataFrame:
    """Chunks and sources of each project."""
    return chunks.groupBy("project").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("source").alias("n_sources"))
