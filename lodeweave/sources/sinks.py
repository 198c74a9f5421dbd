"""Table sinks: appends behind a guard, last-writer-wins upserts, deletions by corpus. A table is a parquet folder, replaced by write and swap."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import is_wrapper
from ..operators.jobs import upsert


def guarded(edges: DataFrame) -> DataFrame:
    """Edges without those that have a resolver wrapper at an end, by its label: `register:RREG32` is one."""
    return edges.where(~is_wrapper(F.substring_index("src", ":", -1)) & ~is_wrapper(F.substring_index("dst", ":", -1)))


def append(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes beside the table, then swaps the folders, so that readers see the old or the new table."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(new), fs_path(path))
    if fs.exists(fs_path(old)):
        fs.delete(fs_path(old), True)


def upsert_table(spark: SparkSession, changes: DataFrame, path: str, key: str, seq: Column) -> None:
    replace(spark, upsert(spark.read.parquet(path), changes, key, seq), path)


def without_corpus(documents: DataFrame, chunks: DataFrame, edges: DataFrame, corpora: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after deleting some corpora: documents, their chunks, and edges whose provenance names one of them."""
    gone = documents.where(F.col("corpus_id").isin(corpora)).select(F.col("id").alias("document_id")).distinct()
    kept = F.coalesce(F.get_json_object("provenance_json", "$.corpus_id"), F.lit("")).isin(corpora)
    return documents.where(~F.coalesce(F.col("corpus_id"), F.lit("")).isin(corpora)), chunks.join(gone, "document_id", "left_anti"), edges.where(~kept)
