"""References to records that are missing, deleted or not there yet, kept as incremental keyed state.

A reference (ref_table, ref_field, row_id, parent_table, key, at) is resolved at a time t if a life
(born, died) of its parent key has born <= t and died null or after t.  ``OrphanState`` takes the
data period by period: deaths close lives of the parent index and births extend it; new references
probe the index, and those without a life wait; arriving parents resolve waiting orphans, deletions
reopen them.  The state lives in tables in the shared folder.

Null and empty keys are no references.  A null time of a reference counts as the earliest, a null
birth as always there.  Repeated rows count once; extra columns are ignored; empty tables give
empty results.  Node ids are compared after trimming blanks.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table, written

REFERENCE = ["ref_table", "ref_field", "row_id", "parent_table", "key", "at"]
#: Keys with more than this share of the references of a period are salted.
HOT_SHARE, SALTS = 0.01, 16
_EARLY = "1970-01-01 00:00:00"


def _time(name: str):
    return F.coalesce(F.col(name).cast("timestamp_ntz"), F.lit(_EARLY).cast("timestamp_ntz"))


def references(chunks: DataFrame, job_events: DataFrame, edges: DataFrame) -> DataFrame:
    """All references of the evidence tables, one shape."""

    def part(df: DataFrame, name: str, field: str, parent: str, at: str) -> DataFrame:
        key = F.trim(F.col(field).cast("string"))
        return df.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col("id").alias("row_id"), F.lit(parent).alias("parent_table"), key.alias("key"), _time(at).alias("at")).where("key <> ''")

    return (
        part(chunks, "chunks", "document_id", "source_documents", "ingested_at")
        .unionByName(part(job_events, "job_events", "job_id", "jobs", "created_at"))
        .unionByName(part(edges, "edges", "src", "graph_nodes", "ingested_at"))
        .unionByName(part(edges, "edges", "dst", "graph_nodes", "ingested_at"))
    )


def lives(source_documents: DataFrame, jobs: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """(parent_table, key, born, died) of the referenced records; jobs are never deleted."""

    def part(df: DataFrame, name: str, born: str, died: str | None) -> DataFrame:
        end = F.col(died).cast("timestamp_ntz") if died else F.lit(None).cast("timestamp_ntz")
        return df.select(F.lit(name).alias("parent_table"), F.trim(F.col("id").cast("string")).alias("key"), _time(born).alias("born"), end.alias("died")).where("key <> ''")

    return part(source_documents, "source_documents", "indexed_at", "deleted_at").unionByName(part(jobs, "jobs", "started_at", None)).unionByName(part(graph_nodes, "graph_nodes", "created_at", "deleted_at"))


def _index(rows: DataFrame) -> DataFrame:
    """The parent index: per key the array of its lives, a few per key, whatever refers to it."""
    return rows.groupBy("parent_table", "key").agg(F.collect_set(F.struct("born", "died")).alias("lives"))


def _alive(t: str):
    return F.expr(f"exists(coalesce(lives, array()), x -> x.born <= {t} and (x.died is null or x.died > {t}))")


def probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References with their key's lives; hot keys are spread over ``SALTS`` parts, their index rows copied."""
    keys = refs.groupBy("parent_table", "key").agg(F.count("*").alias("n"))
    total = refs.agg(F.count("*").alias("total"))
    # at most 1 / HOT_SHARE keys: a proven bound
    hot = keys.join(F.broadcast(total), F.col("n") > HOT_SHARE * F.col("total")).select("parent_table", "key", F.lit(True).alias("_hot"))
    spread = refs.join(F.broadcast(hot), ["parent_table", "key"], "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("ref_table", "ref_field", "row_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint")))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    salted = index.join(F.broadcast(hot), ["parent_table", "key"], "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return spread.join(salted, ["parent_table", "key", "_salt"], "left").drop("_hot", "_salt")


class OrphanState:
    """Parent index and pending orphans, advanced by one period at a time."""

    def __init__(self) -> None:
        self.lives: DataFrame | None = None
        self.orphans: DataFrame | None = None  # REFERENCE + open, resolved_at, reopened_at

    def advance(self, refs: DataFrame, births: DataFrame, deaths: DataFrame) -> DataFrame:
        """Takes one period's references, births and deaths of parents; returns the period's new orphans.

        Births carry a death only if it is known by then; a death names (parent_table, key, born, died).
        """
        known = births if self.lives is None else self.lives.unionByName(births)
        known = known.groupBy("parent_table", "key", "born").agg(F.max("died").alias("died"), F.count("*").alias("_c")).drop("_c")
        ends = deaths.groupBy("parent_table", "key", "born").agg(F.max("died").alias("_died"))
        self.lives = written(known.join(ends, ["parent_table", "key", "born"], "left").select("parent_table", "key", "born", F.coalesce("died", "_died").alias("died")), "lives")
        found = probe(refs.distinct(), _index(self.lives)).where(~_alive("at")).select(*REFERENCE)
        new = written(found.withColumns({"resolved_at": F.lit(None).cast("timestamp_ntz"), "reopened_at": F.lit(None).cast("timestamp_ntz")}), "orphans")
        waiting = new if self.orphans is None else self.orphans.unionByName(new)
        touched = births.select("parent_table", "key").union(deaths.select("parent_table", "key")).distinct()
        # only orphans whose key changed look at the index again
        changed = waiting.join(touched, ["parent_table", "key"], "left_semi").drop("resolved_at", "reopened_at")
        later = F.expr("array_min(transform(filter(coalesce(lives, array()), x -> x.born > at), x -> x.born))")
        reborn = changed.join(_index(self.lives), ["parent_table", "key"], "left").withColumn("resolved_at", later)
        last = F.expr("array_max(transform(lives, x -> coalesce(x.died, timestamp_ntz'9999-12-31 00:00:00')))")
        reborn = reborn.withColumn("reopened_at", F.when(F.col("resolved_at").isNotNull() & (last < F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")), last)).drop("lives")
        kept = waiting.join(touched, ["parent_table", "key"], "left_anti")
        self.orphans = written(kept.unionByName(reborn.select(kept.columns)), "pending")
        return new.select(*REFERENCE)

    def snapshot(self) -> DataFrame:
        """Orphans per table and field: all so far, still open, resolved by a later parent, reopened by its deletion."""
        open_ = F.col("resolved_at").isNull() | F.col("reopened_at").isNotNull()
        return self.orphans.groupBy("ref_table", "ref_field").agg(
            F.count("*").alias("orphans"), F.sum(open_.cast("bigint")).alias("open"), F.sum(F.col("resolved_at").isNotNull().cast("bigint")).alias("resolved"), F.sum(F.col("reopened_at").isNotNull().cast("bigint")).alias("reopened")
        )


def periods(spark, sf_dir: str, bounds: Iterable[str | None]):
    """(references, births, deaths) of each period between neighbouring bounds; None is open."""
    refs = references(*(table(spark, sf_dir, n) for n in ("chunks", "job_events", "edges")))
    parents = lives(*(table(spark, sf_dir, n) for n in ("source_documents", "jobs", "graph_nodes")))
    bounds = list(bounds)
    for low, high in zip(bounds, bounds[1:]):

        def inside(name: str):
            c = F.lit(True)
            if low is not None:
                c = c & (F.col(name) >= F.lit(low).cast("timestamp_ntz"))
            return c if high is None else c & (F.col(name) < F.lit(high).cast("timestamp_ntz"))

        # a death is known from its period on; one that is not after its birth comes with the birth
        known = F.lit(True) if high is None else F.col("died") < F.lit(high).cast("timestamp_ntz")
        births = parents.where(inside("born")).select("parent_table", "key", "born", F.when(known, F.col("died")).alias("died")).distinct()
        deaths = parents.where(F.col("died").isNotNull() & inside("died")).distinct()
        yield refs.where(inside("at")), births, deaths


#: The periods of the evidence tables: half-years of 2024 and 2025, open at both ends.
BOUNDS = (None, "2024-07-01", "2025-01-01", "2025-07-01", None)


def run_periods(spark, sf_dir: str, bounds: Iterable[str | None] = BOUNDS) -> tuple[DataFrame, OrphanState]:
    """All orphans and the state after the last period."""
    state, found = OrphanState(), None
    for refs, births, deaths in periods(spark, sf_dir, bounds):
        new = state.advance(refs, births, deaths)
        found = new if found is None else found.unionByName(new)
    return found, state


def found(spark, sf_dir: str) -> DataFrame:
    orphans, _ = run_periods(spark, sf_dir)
    return orphans.select("ref_table", "ref_field", "row_id").distinct()


def monthly(spark, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and month."""
    orphans, _ = run_periods(spark, sf_dir)
    return orphans.distinct().groupBy("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month")).agg(F.countDistinct("row_id").alias("orphans"))


def snapshot(spark, sf_dir: str, bounds: Iterable[str | None] = BOUNDS) -> DataFrame:
    """The counts at the end of each period, with the period's upper bound (null for the last, open one)."""
    state, out, bounds = OrphanState(), None, list(bounds)
    for (refs, births, deaths), bound in zip(periods(spark, sf_dir, bounds), bounds[1:]):
        state.advance(refs, births, deaths)
        now = state.snapshot().withColumn("period_end", F.lit(bound).cast("timestamp_ntz"))
        out = now if out is None else out.unionByName(now)
    return out
