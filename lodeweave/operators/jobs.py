"""Job log, upserts, freshness policy and audits.

Statuses go through the normaliser, so nulls and unknown ones count as succeeded; broken JSON
counts as empty; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as V


def clean_jobs(jobs: DataFrame) -> DataFrame:
    meta = F.col("metadata_json")
    edge = F.get_json_object(meta, "$.provider_settings.edge")
    return jobs.where("id is not null").dropDuplicates(["id"]).select(
        "id", "kind", V.job_status(F.col("status")).alias("status"), "message", F.get_json_object(edge, "$.provider").alias("provider"), F.get_json_object(edge, "$.model").alias("model"), "started_at", "finished_at"
    )


def latest_succeeded(jobs: DataFrame) -> DataFrame:
    """(kind, job_id): newest succeeded job per kind."""
    return clean_jobs(jobs).where("status = 'succeeded'").groupBy("kind").agg(F.max("id").alias("job_id"))


def freshness_floor(jobs: DataFrame) -> DataFrame:
    """One row (floor): the newest succeeded index or graph_rebuild job; null if there is none."""
    return clean_jobs(jobs).where("status = 'succeeded' and kind in ('index', 'graph_rebuild')").agg(F.max("id").alias("floor"))


def usable_edges(edges: DataFrame, jobs: DataFrame, provider: str, model: str, with_evidence: bool = False) -> DataFrame:
    """Edges that the freshness policy lets through.

    Evidence edges are hidden unless asked for, deterministic ones visible; a semantic edge needs a
    succeeded job of the semantic kinds with the current provider and model, not older than the floor.
    Without any semantic job and floor the policy isn't enforced.
    """
    j = clean_jobs(jobs)
    valid = j.where((F.col("status") == "succeeded") & F.col("kind").isin("semantic_edges", "semantic_edges_batch", "doc_nodes_batch") & (F.col("provider") == provider) & (F.col("model") == model))
    floor = freshness_floor(jobs)
    any_semantic = j.where(F.col("kind").isin("semantic_edges", "semantic_edges_batch", "doc_nodes_batch")).agg(F.count("*").alias("n"))
    policy = floor.crossJoin(any_semantic)  # one row by one row
    e = edges.withColumn("job_id", F.expr("try_cast(get_json_object(provenance_json, '$.job_id') as bigint)"))
    e = e.join(valid.select(F.col("id").alias("job_id"), F.lit(True).alias("_valid")), "job_id", "left").crossJoin(F.broadcast(policy))
    enforced = (F.col("n") > 0) | F.col("floor").isNotNull()
    fresh = F.col("_valid").isNotNull() & (F.coalesce("floor", F.lit(0)) <= F.col("job_id"))
    ok = F.when(F.col("stage") == "evidence", F.lit(with_evidence)).when(F.col("stage") != "semantic", True).otherwise(~enforced | fresh)
    return e.where(F.coalesce(ok, F.lit(True))).drop("_valid", "floor", "n")


def supersede(jobs: DataFrame, kind: str, newest: int) -> DataFrame:
    """Jobs after a new one of a kind began: older queued, indexing and failed ones become superseded."""
    j = clean_jobs(jobs)
    old = (F.col("kind") == kind) & (F.col("id") < newest) & F.col("status").isin("queued", "indexing", "failed")
    return j.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).select("id", "kind", "status")


def lifecycle(events: DataFrame) -> DataFrame:
    """(job_id, lifecycle, last_status, events): statuses in order of event id, repeated neighbours once."""
    e = events.where("id is not null and job_id is not null").dropDuplicates(["id"]).select("id", "job_id", V.job_status(F.col("status")).alias("status"))
    order = W.partitionBy("job_id").orderBy("id")
    changed = e.withColumn("_p", F.lag("status").over(order)).where("_p is null or _p <> status")
    path = changed.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "status"))), lambda x: x["status"]), " -> ").alias("lifecycle"))
    last = e.groupBy("job_id").agg(F.max_by("status", "id").alias("last_status"), F.count("*").alias("events"))
    return path.join(last, "job_id")


def upsert(current: DataFrame, changes: DataFrame, key: str, seq: Column) -> DataFrame:
    """Last writer wins: one row per key, the one with the highest sequence, changes after current rows."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    order = W.partitionBy(key).orderBy(F.desc("_side"), seq.desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_side")


def index_status(jobs: DataFrame) -> DataFrame:
    """One row: failed before indexing or queued before ready before not indexed."""
    j = clean_jobs(jobs)
    return j.agg(
        F.when(F.count("*") == 0, "empty").when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status").isin("indexing", "queued")), "indexing").when(F.bool_or(F.col("status") == "succeeded"), "ready").otherwise("not indexed").alias("index_status")
    )


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """One row (chunks, embedded, missing, verdict)."""
    c = chunks.where("id is not null").select("id").distinct()
    e = embeddings.select(F.col(key).alias("id")).distinct().withColumn("_e", F.lit(1))
    g = c.join(e, "id", "left").agg(F.count("*").alias("chunks"), F.count("_e").alias("embedded"))
    return g.withColumn("missing", F.col("chunks") - F.col("embedded")).withColumn("verdict", F.when(F.col("missing") == 0, "pass").when(F.col("embedded") > 0, "partial").otherwise("fail"))


def stale_semantic(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counts over semantic edges: all, without a job, older than the floor, of a job that isn't known."""
    e = edges.where("stage = 'semantic'").select(F.expr("try_cast(get_json_object(provenance_json, '$.job_id') as bigint)").alias("job_id"))
    known = clean_jobs(jobs).select(F.col("id").alias("job_id"), F.lit(1).alias("_k"))
    e = e.join(known, "job_id", "left").crossJoin(F.broadcast(freshness_floor(jobs)))  # one row
    n = lambda c: F.count(F.when(c, 1))
    return e.agg(F.count("*").alias("semantic"), n(F.col("job_id").isNull()).alias("without_job"), n(F.col("job_id") < F.col("floor")).alias("stale"), n(F.col("job_id").isNotNull() & F.col("_k").isNull()).alias("unknown_job"))
