"""Graph payloads, vector stages, configuration values and the preprocessor mask, on small inputs with nulls, ties and empty tables."""

import json

import pytest
from lodeweave.operators import audit, payload
from lodeweave.operators import graph as G
from lodeweave.operators import retrieval as R
from lodeweave.operators.codegraph import masked
from lodeweave.sources import config
from lodeweave.sources.sinks import guarded
from pyspark.sql import functions as F

EDGE = "id bigint, src string, dst string, relation string, confidence double, stage string, source string, path string, line_start int, line_end int, provenance_json string, extra string, ingested_at timestamp"


def edges(spark, rows):
    full = [(k, s, d, r, 0.8, "deterministic", "clang", None, None, None, None, "x", None) for k, (s, d, r) in enumerate(rows)]
    return spark.createDataFrame(full, EDGE)


def test_only_the_first_branch_that_holds_is_read():
    read = lambda t, *names: [x for x in masked(t, frozenset(names)).split("\n") if x.strip()]
    assert read("#ifdef A\na\n#elif B\nb\n#else\nc\n#endif\nd") == ["a", "d"]
    assert read("#if 0\na\n#elif 0\nb\n#else\nc\n#endif") == ["c"]
    assert read("#ifdef CONFIG_X\na\n#elif 1\nb\n#else\nc\n#endif") == ["b"]
    assert read("#ifdef CONFIG_X\na\n#else\nb\n#endif", "CONFIG_X") == ["a"]
    assert read("#if !defined(CONFIG_X)\na\n#else\nb\n#endif") == ["a"]
    assert read("#if 0\n#if 1\na\n#else\nb\n#endif\n#else\nc\n#endif") == ["c"]
    assert read("#define M(a) \\\n  x(a)\ny") == ["y"]
    assert masked("") == "" and read("#else\na\n#endif\nb") == ["a", "b"]


def test_subgraph_keeps_seeds_without_edges(spark):
    w = G.weighted(G.clean_edges(edges(spark, [("register:A:x", "function:r:p:f", "writes"), ("function:r:p:f", "register:A:y", "reads"), ("register:A:x", "function:r:p:f", "writes"), (None, "z", "reads")])))
    seeds = spark.createDataFrame([("register:A:x",), ("register:A:none",)], "node string")
    nodes, found = payload.subgraph(w, seeds, 1)
    assert {(r.node, r.weight) for r in nodes.collect()} == {("register:A:x", 1.0), ("function:r:p:f", 1.0), ("register:A:none", 1.0)}
    assert found.count() == 1 and payload.subgraph(w, seeds, 2)[1].count() == 2
    n, e = payload.query_graph(w, spark.createDataFrame([("y", 3.0), ("y", 2.0), ("gone", 9.0)], "symbol string, rank_score double"), 1)
    assert {r.src for r in e.collect()} == {"function:r:p:f"} and n.count() == 2
    assert payload.subgraph(w.limit(0), seeds.limit(0), 3)[0].count() == 0


def test_fields_fold_into_their_register(spark):
    e = edges(spark, [("register:A:x", "field:B", "sets_field"), ("field:C", "register:A:x", "sets_field"), ("register:A:x", "field:B", "sets_field"), ("function:a:b:c", "register:A:x", "sets_field"), ("register:A:x", None, "sets_field")])
    left, fields = payload.folded(e)
    assert left.count() == 2 and [(r.register, r.fields) for r in fields.collect()] == [("register:A:x", ["field:B", "field:C"])]


def test_client_filters(spark):
    w = G.weighted(G.clean_edges(edges(spark, [("register:A:x", "function:r:p:f", "writes"), ("docs/a.md#b", "register:A:x", "documents"), ("function:r:p:f", "function:r:p:g", "calls")])))
    nodes = G.node_weights(w)
    n, e = payload.selected(nodes, w, ["calls"])
    assert e.count() == 1 and {r.node for r in n.collect()} == {"function:r:p:f", "function:r:p:g"}
    assert payload.selected(nodes, w.limit(0), ["calls"])[0].count() == nodes.count()
    assert payload.sanitised(nodes, w, ["register", "function"])[1].count() == 2
    some, kept = payload.visible(nodes, w, 2, 5)
    assert some.count() == 2 and kept.count() <= 1
    assert guarded(edges(spark, [("register:RREG32", "a", "reads"), ("b", "c", "reads")])).count() == 1
    assert not payload.under_cap(w, 2) and payload.under_cap(w, 3)


def test_vectors_count_after_the_cut(spark):
    assert R.query_vector("what about CP_HQD_*")[1] == "skipped-symbol-prefix" and R.query_vector("ring_buffer size")[1] == "skipped-symbol-token"
    assert R.query_vector("plain words", lambda q: [[1, 2]]) == ([1.0, 2.0], "provider")
    vector, source = R.query_vector("plain words", lambda q: 1 / 0)
    assert source == "deterministic-fallback" and len(vector) == 8
    from lodeweave.functions import vectors as X

    assert spark.range(1).select(X.deterministic_embedding(F.lit("plain words")).alias("v")).first().v == vector
    m = spark.createDataFrame([(1, 0.9, "provider"), (2, 0.8, "deterministic"), (3, 0.5, "deterministic")], "chunk_id bigint, score double, source string")
    assert {r.chunk_id for r in R.compatible(m, "deterministic-fallback").collect()} == {2} and R.compatible(m, "provider").count() == 2
    rows = spark.createDataFrame([(1, "a", 1.0), (4, "b", 1.0)], "chunk_id bigint, symbol string, rank_score double")
    assert {(r.chunk_id, r.rank_score) for r in R.with_vectors(rows, m, "chunk_id").collect()} == {(1, 2.8), (4, 1.0)}
    more = spark.createDataFrame([(1, "a", 0.0), (1, "c", 0.0), (9, "d", 0.0)], rows.schema)
    assert {(r.chunk_id, r.symbol) for r in R.injected(rows, more, m).collect()} == {(1, "a"), (4, "b"), (1, "c")}


def test_best_rank_counts_the_rows_before(spark):
    rows = spark.createDataFrame([(3.0, "a", 1), (3.0, "bSTATUS", 2), (9.0, "z", 3), (1.0, "cSTATUS", 4)], "rank_score double, symbol string, chunk_id bigint")
    assert [(r.rank, r.key) for r in R.best_rank(rows, F.col("symbol").contains("STATUS")).collect()] == [(3, "bSTATUS")]
    assert R.best_rank(rows, F.lit(False)).count() == 0


def test_audits(spark):
    jobs = spark.createDataFrame([(1, "a", "succeeded"), (2, "b", "error"), (3, "b", "queued"), (None, "c", "failed"), (1, "a", "succeeded")], "id bigint, kind string, status string")
    assert {r.id for r in audit.blocking_jobs(jobs).collect()} == {2, 3}
    full = [(k, "a", "b", "calls", 0.5, s, "x", None, None, None, p, "e", None) for k, (s, p) in enumerate([("one", '{"job_id": 1, "extractor": "x"}'), ("one", "{bad"), ("two", '{"job_id": 7}'), ("two", None)])]
    e = spark.createDataFrame(full, EDGE)
    assert [(r.job_id, r.edges) for r in audit.missing_jobs(e, jobs).collect()] == [(7, 1)]
    found = {r.stage: r.verdict for r in audit.extractor_provenance(e).collect()}
    assert found == {"one": "partial", "two": "fail"}
    assert audit.verdicts(spark.createDataFrame([("pass",)], "status string")).first().gate == "pass"
    assert audit.verdicts(spark.createDataFrame([], "status string")).first().gate == "blocked"
    events = spark.createDataFrame([(5, 1, "x", None, None), (4, 1, None, "", None), (6, None, "x", "", None)], "id bigint, job_id bigint, status string, message string, created_at timestamp")
    assert sorted((r.job_id, r.position) for r in audit.job_history(jobs, events).where("job_id = 1").collect()) == [(1, 1), (1, 2)]
    pollution = audit.identifier_pollution(edges(spark, [("function:r:p:if", "function:r:p:f", "calls"), ("function:r:p:f", "function:r:p:a-b", "calls")]))
    assert {(r.name, r.fault) for r in pollution.collect()} == {("if", "control word"), ("a-b", "no identifier")}


def test_configuration_values(tmp_path):
    assert config.expanded("env:A", {"A": "1"}) == "1" and config.expanded("x-${ENV:A}-${ENV:B}", {"A": "1", "B": "2"}) == "x-1-2"
    with pytest.raises(KeyError, match="A"):
        config.expanded("env:A", {})
    assert config.source_roots(["a=/x", " b = /y=z "]) == {"a": "/x", "b": "/y=z"}
    with pytest.raises(ValueError):
        config.source_roots(["a"])
    assert config.source_root("a-b", {}, None, ["/nowhere", str(tmp_path)], {}) == str(tmp_path)
    assert config.source_root("a-b", {}, "/c", [], {"CORPUS_ROOT_A_B": "/e"}) == "/e" and config.source_root("a", {"a": "/o"}, "/c", [], {}) == "/o"
    assert config.selected(["One", "two"], ["TWO", "one"]) == ["two", "One"]
    assert config.recovered('text {"a": {"b": "}"}} more') == {"a": {"b": "}"}} and config.recovered("```json\n[1]\n```") is None and config.recovered('{bad} {"a": 1}') == {"a": 1}
    assert config.integer("7x") is None and config.integer("-3", 1) == 1 and config.strings(None) == [] and config.strings("a") == ["a"] and config.strings(["", "b", None]) == ["b"]
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"a": 1}))
    assert config.load(str(p)) == {"a": 1} and config.load(str(tmp_path / "none.json")) == {}
