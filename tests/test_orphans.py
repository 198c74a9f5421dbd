"""Orphan references against brute force, with nulls, ties, repeated rows, hot keys and empty tables."""

import random
from datetime import datetime, timedelta

import pytest
from lodeweave.operators import orphans as O

T0 = datetime(2024, 1, 1)


def make(spark, folder, seed, n):
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(days=rng.randrange(700))
    docs, lives = [], []
    for i in range(12):
        born = at()
        died = born + timedelta(days=rng.randrange(0, 200)) if rng.random() < 0.5 else None
        docs.append((i, born, died))
        if died and rng.random() < 0.5:
            docs.append((i, died + timedelta(days=20), None))
    chunks = [(k, 3 if rng.random() < 0.4 else rng.choice([None, *range(16)]), at()) for k in range(n)]
    chunks += chunks[:2]
    nodes = [(f"n{i}", at(), None) for i in range(5)]
    edges = [(k, rng.choice([" n1 ", "n2", "", None, "n9"]), rng.choice(["n0", "n4", "zz"]), at()) for k in range(n)]
    jobs = [(i, at()) for i in range(6)]
    events = [(k, rng.choice([None, *range(8)]), at()) for k in range(n)]
    spec = {
        "source_documents": (docs, "id bigint, indexed_at timestamp_ntz, deleted_at timestamp_ntz"),
        "chunks": (chunks, "id bigint, document_id bigint, ingested_at timestamp_ntz"),
        "graph_nodes": (nodes, "id string, created_at timestamp_ntz, deleted_at timestamp_ntz"),
        "edges": (edges, "id bigint, src string, dst string, ingested_at timestamp_ntz"),
        "jobs": (jobs, "id bigint, started_at timestamp_ntz"),
        "job_events": (events, "id bigint, job_id bigint, created_at timestamp_ntz"),
    }
    for name, (rows, schema) in spec.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    parents = {("d", str(i)): [] for i, *_ in docs}
    for i, b, d in docs:
        parents["d", str(i)].append((b, d))
    for i, b, d in nodes:
        parents.setdefault(("n", i), []).append((b, d))
    for i, b in jobs:
        parents.setdefault(("j", str(i)), []).append((b, None))

    def orphan(kind, key, t):
        key = "" if key is None else str(key).strip()
        return key != "" and not any(b <= t and (d is None or d > t) for b, d in parents.get((kind, key), []))

    want = {("chunks", "document_id", k) for k, d, t in chunks if orphan("d", d, t)} | {("job_events", "job_id", k) for k, j, t in events if orphan("j", j, t)}
    return want | {("edges", "src", k) for k, s, _, t in edges if orphan("n", s, t)} | {("edges", "dst", k) for k, _, d, t in edges if orphan("n", d, t)}


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 0)])
def test_found(spark, tmp_path, seed, n):
    want = make(spark, str(tmp_path), seed, n)
    got = [tuple(r) for r in O.found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_later_parents_resolve_and_deletions_reopen(spark):
    state = O.OrphanState()
    ref = "ref_table string, ref_field string, row_id bigint, parent_table string, key string, at timestamp_ntz"
    life = "parent_table string, key string, born timestamp_ntz, died timestamp_ntz"
    none = spark.createDataFrame([], life)
    day = lambda n: T0 + timedelta(days=n)
    new = state.advance(spark.createDataFrame([("chunks", "document_id", 1, "d", "x", day(1)), ("chunks", "document_id", 2, "d", "y", day(1))], ref), none, none)
    assert new.count() == 2 and state.snapshot().first().open == 2
    state.advance(spark.createDataFrame([], ref), spark.createDataFrame([("d", "x", day(5), None)], life), none)
    s = state.snapshot().first()
    assert (s.orphans, s.open, s.resolved, s.reopened) == (2, 1, 1, 0)
    state.advance(spark.createDataFrame([], ref), none, spark.createDataFrame([("d", "x", day(5), day(9))], life))
    s = state.snapshot().first()
    assert (s.orphans, s.open, s.resolved, s.reopened) == (2, 2, 1, 1)
