"""Checks over jobs, edges and embeddings: what blocks a release of the index, and where derived rows come from.

Nulls and broken JSON count as missing provenance; repeated rows count once by id; empty tables
give zero counts or no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions import vocab as V
from .jobs import clean_jobs


def job_history(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, kind, status, position, event_status, message, created_at): a job's events in the order of their ids, jobs without events once with nulls.

    A skewed job's events stay rows; none are collected.
    """
    from pyspark.sql import Window as W

    j = jobs.where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("job_id"), "kind", "status")
    e = events.where("id is not null and job_id is not null").dropDuplicates(["id"]).select("job_id", F.col("id").alias("_e"), F.col("status").alias("event_status"), "message", "created_at")
    place = F.row_number().over(W.partitionBy("job_id").orderBy("_e"))
    return j.join(e.withColumn("position", place), "job_id", "left").select("job_id", "kind", "status", "position", "event_status", "message", "created_at")


def blocking_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that have failed, still run or wait."""
    j = jobs.where("id is not null").dropDuplicates(["id"])
    return j.select("id", "kind", V.job_status(F.col("status")).alias("status")).where(F.col("status").isin("failed", "indexing", "queued"))


def missing_jobs(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, edges): job ids that edges name and no succeeded job has."""
    named = edges.dropDuplicates(["id"]).select(C.json_field(F.col("provenance_json"), "job_id").try_cast("bigint").alias("job_id")).where("job_id is not null")
    done = jobs.where("id is not null").select(F.col("id").alias("job_id"), V.job_status(F.col("status")).alias("_s")).where("_s = 'succeeded'").select("job_id").distinct()
    return named.groupBy("job_id").agg(F.count("*").alias("edges")).join(done, "job_id", "left_anti")


def extractor_provenance(edges: DataFrame) -> DataFrame:
    """Per stage: edges, those with an extractor in their provenance, and the verdict pass, partial or fail (none)."""
    e = edges.where("id is not null").dropDuplicates(["id"]).select("stage", (C.json_field(F.col("provenance_json"), "extractor") != "").alias("_x"))
    g = e.groupBy("stage").agg(F.count("*").alias("edges"), F.sum(F.coalesce("_x", F.lit(False)).cast("bigint")).alias("with_extractor"))
    return g.withColumn("verdict", F.when(F.col("with_extractor") == F.col("edges"), "pass").when(F.col("with_extractor") > 0, "partial").otherwise("fail"))


def identifier_pollution(edges: DataFrame) -> DataFrame:
    """(id, name, fault): function ends of call edges whose name is a control word or no identifier."""
    words = ["if", "for", "while", "switch", "return", "sizeof", "do", "else", "case"]
    ends = edges.where("relation = 'calls'").select("id", F.explode(F.array("src", "dst")).alias("_n")).where(F.col("_n").startswith("function:"))
    named = ends.select("id", F.element_at(F.split("_n", ":"), -1).alias("name")).distinct()
    fault = F.when(F.col("name").isin(words), "control word").when(~F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "no identifier")
    return named.withColumn("fault", fault).where("fault is not null")


def verdicts(results: DataFrame) -> DataFrame:
    """One row of counts of pass, partial and fail (status), and the gate: pass only if all pass, else blocked."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("bigint")), F.lit(0))
    return results.agg(F.count("*").alias("queries"), n("pass").alias("passed"), n("partial").alias("partial"), n("fail").alias("failed")).withColumn("gate", F.when((F.col("queries") > 0) & (F.col("passed") == F.col("queries")), "pass").otherwise("blocked"))


def kinds_of_jobs(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """(stage, kind, edges): job kinds behind the edges of each stage; null for edges without a known job."""
    k = jobs.where("id is not null").groupBy(F.col("id").alias("_j")).agg(F.min("kind").alias("kind"))
    e = edges.where("id is not null").dropDuplicates(["id"]).select("stage", C.json_field(F.col("provenance_json"), "job_id").try_cast("bigint").alias("_j"))
    return e.join(k, "_j", "left").groupBy("stage", "kind").agg(F.count("*").alias("edges"))


def pending_work(jobs: DataFrame) -> DataFrame:
    """Newest id per kind of the jobs that haven't ended."""
    j = clean_jobs(jobs).where(F.col("status").isin("indexing", "queued"))
    return j.groupBy("kind").agg(F.max("id").alias("newest"), F.count("*").alias("jobs"))
