"""Queries of symbols' and endpoints' predicates, graph payloads, vector retrieval and audits, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as C
from .functions import vocab as V
from .operators import audit as A
from .operators import evidence as E
from .operators import graph as G
from .operators import payload as P
from .operators import retrieval as R
from .queries import _EDGES, _STATUS, _WEIGHTED, query

# Names that are never an endpoint of a product graph.
NO_ENDPOINTS = ["data", "ret", "value", "tmp", "local", "uint32_t", "void", "static", "return"]

_JSON = "CASE WHEN starts_with(trim(provenance_json), '{{') AND json_valid(provenance_json) THEN json_extract_string(provenance_json, '$.{0}') END"
_KIND = "CASE WHEN starts_with({0}, 'register:') THEN 'register' WHEN starts_with({0}, 'function:') THEN 'function' ELSE 'doc' END"
_LABEL = "split_part({0}, ':', -1)"
_ONE = "e1 AS (SELECT DISTINCT ON (id) * FROM edges WHERE id IS NOT NULL)"

_ENDPOINT = """CASE WHEN lower({0}) IN ('data', 'ret', 'value', 'tmp', 'local', 'uint32_t', 'void', 'static', 'return') OR regexp_matches(lower({0}), '^(data_|local_|ret_|tmp_|value_|enable_|disable_)') THEN NULL
 WHEN contains({0}, ':') THEN CASE WHEN lower(split_part({0}, ':', 1)) IN ('doc', 'doc_box', 'doc_section', 'pdf_section') THEN 'doc' WHEN lower(split_part({0}, ':', 1)) IN ('function', 'register') THEN lower(split_part({0}, ':', 1)) END
 WHEN regexp_matches(lower({0}), '[.](md|rst|txt|pdf)#') THEN 'doc' WHEN regexp_matches({0}, '^(reg|mm|smn).') THEN 'register'
 WHEN regexp_matches({0}, '^[A-Z][A-Z0-9_]*$') AND regexp_matches({0}, 'CNTL|CTRL|STATUS|BASE|RESET') THEN 'register'
 WHEN regexp_matches({0}, '^[A-Za-z_][A-Za-z0-9_]*$') AND contains({0}, '_') AND regexp_matches({0}, '[a-z]') THEN 'function' END"""


def _weighted(t):
    return G.weighted(G.clean_edges(t("edges")))


@query("scl_07_function_symbols", "SELECT DISTINCT name, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT (name = upper(name) AND regexp_matches(name, '[A-Z]')) AS is_function FROM function_locations WHERE name IS NOT NULL")
def _(t):
    return t("function_locations").where("name is not null").select("name", C.is_function_symbol(F.col("name")).alias("is_function")).distinct()


@query(
    "scl_08_callables",
    r"""WITH c AS (SELECT DISTINCT id, document_id, text FROM chunks WHERE id IS NOT NULL AND document_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT DISTINCT document_id, id, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+)\s*\(', 1)) AS name FROM c)
SELECT location_id, count(DISTINCT id) AS chunks FROM (SELECT DISTINCT location_id, document_id, name FROM function_locations) f JOIN n USING (document_id, name) GROUP BY 1""",
)
def _(t):
    c = t("chunks").where("id is not null and document_id is not null and text is not null").select("id", "document_id", F.explode(C.callables(F.col("text"))).alias("name")).distinct()
    f = t("function_locations").select("location_id", "document_id", "name").distinct()
    return f.join(c, ["document_id", "name"]).groupBy("location_id").agg(F.countDistinct("id").alias("chunks"))


@query(
    "scl_12_register_identities",
    """SELECT DISTINCT id, 'register:' || split_part(id, ':', -1) AS merged, 'register:' || split_part(id, ':', -1) || CASE WHEN len(string_split(id, ':')) > 2 AND split_part(id, ':', 2) <> '' THEN ':' || split_part(id, ':', 2) ELSE ':' END AS by_block
FROM graph_nodes WHERE starts_with(id, 'register:')""",
)
def _(t):
    symbol, block = F.substring_index("id", ":", -1), F.when(F.size(F.split("id", ":")) > 2, F.element_at(F.split("id", ":"), 2)).otherwise("")
    n = t("graph_nodes").where(F.col("id").startswith("register:"))
    return n.select("id", C.register_identity(symbol, block, F.lit("")).alias("merged"), C.register_identity(symbol, block, F.lit(""), merge_blocks=False).alias("by_block")).distinct()


@query("scl_22_tones", "WITH d AS (SELECT DISTINCT id, lower(source_type) s FROM source_documents) SELECT id, CASE WHEN s IN ('pdf', 'doc') THEN s WHEN s = 'register' THEN 'register' ELSE 'code' END AS tone FROM d")
def _(t):
    s = F.lower("source_type")
    return t("source_documents").select("id", C.tone(s, F.coalesce(s, F.lit(""))).alias("tone")).distinct()


@query("scl_23_query_ids", "SELECT DISTINCT item_id, 'eval_' || trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS query_id FROM eval_items WHERE regexp_matches(lower(text), '[a-z0-9]')")
def _(t):
    e = t("eval_items").where(F.lower("text").rlike("[a-z0-9]"))
    return e.select("item_id", C.query_id(F.lit(""), F.lit(" eval "), F.col("text")).alias("query_id")).distinct()


@query(
    "scl_24_ordered_pairs",
    f"""WITH {_EDGES}, k AS (SELECT DISTINCT src, dst, CASE {_KIND.format('src')} WHEN 'register' THEN 0 WHEN 'doc' THEN 3 ELSE 9 END a, CASE {_KIND.format('dst')} WHEN 'register' THEN 0 WHEN 'doc' THEN 3 ELSE 9 END b FROM e)
SELECT DISTINCT CASE WHEN a > b OR (a = b AND src > dst) THEN dst ELSE src END AS "first", CASE WHEN a > b OR (a = b AND src > dst) THEN src ELSE dst END AS second FROM k""",
)
def _(t):
    e = G.clean_edges(t("edges"))
    p = C.ordered_pair(F.col("src"), G.node_kind(F.col("src")), F.col("dst"), G.node_kind(F.col("dst")))
    return e.select(p.alias("p")).select("p.first", "p.second").distinct()


@query(
    "scl_21_provenance_fields",
    f"WITH {_ONE} SELECT id, {_JSON.format('extractor')} AS extractor, {_JSON.format('corpus_id')} AS corpus_id, coalesce(TRY_CAST({_JSON.format('job_id')} AS BIGINT), 0) AS job_id FROM e1",
)
def _(t):
    p = lambda n: C.json_field(F.col("provenance_json"), n)
    return t("edges").where("id is not null").dropDuplicates(["id"]).select("id", p("extractor").alias("extractor"), p("corpus_id").alias("corpus_id"), C.lenient_int(p("job_id")).alias("job_id"))


@query("flt_02_equality_filters", "SELECT DISTINCT id, path FROM source_documents WHERE lower(source_type) IN ('code', 'register') AND lower(corpus_id) = 'solen-mxvirt'")
def _(t):
    return R.equal(t("source_documents"), {"corpus_id": "SOLEN-mxvirt"}, {"source_type": ["code", "Register"]}).select("id", "path").distinct()


@query("flt_04_id_exclusion", "SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND id NOT IN (SELECT document_id FROM function_locations WHERE document_id IS NOT NULL)")
def _(t):
    out = t("function_locations").where("document_id is not null").select(F.col("document_id").alias("id")).distinct()
    return t("chunks").where("id is not null").select("id").distinct().join(out, "id", "left_anti")


@query(
    "flt_08_product_edges",
    f"WITH {_EDGES}, k AS (SELECT DISTINCT src, dst, {_ENDPOINT.format('src')} AS src_kind, {_ENDPOINT.format('dst')} AS dst_kind FROM e) SELECT * FROM k WHERE src_kind IS NOT NULL AND dst_kind IS NOT NULL AND src <> dst",
)
def _(t):
    return P.product_edges(G.clean_edges(t("edges")), NO_ENDPOINTS).select("src", "dst", "src_kind", "dst_kind").distinct()


@query("flt_10_selected_edges", f"WITH {_WEIGHTED} SELECT src, dst, relation, weight FROM w WHERE relation IN ('calls', 'writes') AND stage = 'deterministic' AND list_has_any(sources, ['clang'])")
def _(t):
    w = _weighted(t)
    return P.selected(G.node_weights(w), w, ["calls", "writes"], ["deterministic"], ["clang"])[1].select("src", "dst", "relation", "weight")


@query("flt_11_visible_edges")
def _(t):
    w = _weighted(t)
    return P.visible(G.node_weights(w), w, 200, 400, 0.5)[1].select("src", "dst", "relation", "weight")


@query("flt_12_sanitised_edges", f"WITH {_WEIGHTED} SELECT src, dst, relation FROM w WHERE {_KIND.format('src')} IN ('register', 'function') AND {_KIND.format('dst')} IN ('register', 'function')")
def _(t):
    w = _weighted(t)
    return P.sanitised(G.node_weights(w), w, ["register", "function"])[1].select("src", "dst", "relation")


@query(
    "flt_13_identifier_pollution",
    f"""WITH {_EDGES}, n AS (SELECT DISTINCT id, split_part(x, ':', -1) AS name FROM (SELECT id, unnest([src, dst]) x FROM e WHERE relation = 'calls') WHERE starts_with(x, 'function:')),
f AS (SELECT id, name, CASE WHEN name IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'do', 'else', 'case') THEN 'control word' WHEN NOT regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') THEN 'no identifier' END AS fault FROM n)
SELECT * FROM f WHERE fault IS NOT NULL""",
)
def _(t):
    return A.identifier_pollution(G.clean_edges(t("edges")))


@query("agg_18_evidence_cap", "SELECT (SELECT count(*) FROM edges) <= 1000 AS small, (SELECT count(*) FROM edges) <= 100000000 AS large")
def _(t):
    return t.spark.createDataFrame([(P.under_cap(t("edges"), 1000), P.under_cap(t("edges"), 100_000_000))], "small boolean, large boolean")


_SEED = "(SELECT min(src) FROM e WHERE starts_with(src, 'register:'))"


@query(
    "grf_02_legacy_hops",
    f"""WITH {_EDGES}, s AS (SELECT {_SEED} n), h1 AS (SELECT src, dst, relation, confidence FROM e WHERE src IN (FROM s) OR dst IN (FROM s)),
f AS (SELECT src n FROM h1 UNION SELECT dst FROM h1), h2 AS (SELECT src, dst, relation, confidence FROM e WHERE src IN (FROM f) OR dst IN (FROM f))
SELECT src, dst, relation, min(confidence) AS confidence FROM h2 GROUP BY 1, 2, 3""",
)
def _(t):
    e = G.clean_edges(t("edges"))
    seed = e.where(F.col("src").startswith("register:")).agg(F.min("src")).first()[0]
    return P.legacy_hops(e, seed or "", 2)


_NEAR = f"""s AS (SELECT min(src) n FROM w WHERE starts_with(src, 'register:')), x AS (SELECT * FROM w WHERE src IN (FROM s) OR dst IN (FROM s))"""


@query(
    "grf_05_subgraph_nodes",
    f"WITH {_WEIGHTED}, {_NEAR} SELECT node, {_KIND.format('node')} AS kind, {_LABEL.format('node')} AS label, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT unnest([src, dst]) node FROM x) GROUP BY 1",
)
def _(t):
    w = _weighted(t)
    return P.subgraph(w, w.where(F.col("src").startswith("register:")).agg(F.min("src").alias("node")), 1)[0]


@query("grf_05_subgraph_edges", f"WITH {_WEIGHTED}, {_NEAR} SELECT src, dst, relation, confidence, weight FROM x")
def _(t):
    w = _weighted(t)
    return P.subgraph(w, w.where(F.col("src").startswith("register:")).agg(F.min("src").alias("node")), 1)[1].select("src", "dst", "relation", "confidence", "weight")


@query("grf_06_seed_only", "SELECT 'register:NONE' AS node, 'register' AS kind, 'NONE' AS label, 1.0::DOUBLE AS weight")
def _(t):
    return P.subgraph(_weighted(t).where("false"), t.spark.createDataFrame([("register:NONE",)], "node string"), 2)[0]


@query("grf_07_query_graph")
def _(t):
    w = _weighted(t)
    labels = w.select(G.label(F.col("src")).alias("symbol"), F.col("weight").alias("rank_score"))
    return P.query_graph(w, labels, 1)[1].select("src", "dst", "relation", "weight")


@query("aux_06_multigraph", f"WITH {_EDGES} SELECT DISTINCT id, src, dst, relation FROM e")
def _(t):
    return P.unwrapped(G.clean_edges(t("edges"))).select("id", "src", "dst", "relation").distinct()


@query("cli_03_provenance_labels")
def _(t):
    return P.provenance_label(t("edges").where("id is not null").dropDuplicates(["id"])).select("id", "provenance")


# ---------------------------------------------------------------- vectors


@query(
    "jon_02_vector_documents",
    """WITH a AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), q AS (SELECT v FROM a WHERE vec_id = 3), s AS (SELECT vec_id, round(list_cosine_similarity(a.v, q.v), 6) AS score FROM a, q),
k AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 25)
SELECT vec_id, score, lang, n_chars FROM k JOIN documents ON doc_id = vec_id""",
)
def _(t):
    row = t("embeddings").where("vec_id = 3").select("embedding").first()
    near = R.vector_top(t("embeddings"), "vec_id", "embedding", list(row.embedding) if row else [0.0], 25)
    return t("documents").join(F.broadcast(near), F.col("doc_id") == F.col("vec_id")).select("vec_id", "score", "lang", "n_chars")  # at most 25 rows


@query(
    "jon_14_vector_scores",
    """WITH a AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), q AS (SELECT v FROM a WHERE vec_id = 3), s AS (SELECT vec_id, round(list_cosine_similarity(a.v, q.v), 6) AS score FROM a, q),
k AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 25)
SELECT doc_id, round(1 + 2 * coalesce(CASE WHEN score >= 0.75 THEN score END, 0), 4) AS rank_score FROM documents LEFT JOIN k ON doc_id = vec_id""",
)
def _(t):
    row = t("embeddings").where("vec_id = 3").select("embedding").first()
    near = R.compatible(R.vector_top(t("embeddings"), "vec_id", "embedding", list(row.embedding) if row else [0.0], 25), None)
    return R.with_vectors(t("documents").select("doc_id").withColumn("rank_score", F.lit(1.0)), near.withColumnRenamed("vec_id", "doc_id"), "doc_id").select("doc_id", "rank_score")


@query("ret_13_evidence_detail")
def _(t):
    rows = E.evidence(t("chunks").where("id = 5"), t("source_documents"))
    return rows.select("chunk_id", "symbol", "entity_type", "access_type", "snippet")


@query("ret_14_entity_explain")
def _(t):
    rows = R.query_evidence(E.evidence(t("chunks"), t("source_documents")), t("chunks"), "SDMA ring status")
    w = _weighted(t)
    return P.query_graph(w, rows.select("symbol", "rank_score"), 1)[0]


# ---------------------------------------------------------------- audits


@query(
    "aux_01_job_history",
    """WITH j AS (SELECT DISTINCT ON (id) id job_id, kind, status FROM jobs WHERE id IS NOT NULL), v AS (SELECT DISTINCT ON (id) * FROM job_events WHERE id IS NOT NULL AND job_id IS NOT NULL),
p AS (SELECT job_id, status event_status, message, created_at, row_number() OVER (PARTITION BY job_id ORDER BY id) AS position FROM v)
SELECT j.job_id, kind, status, CAST(position AS INT) AS position, event_status, message, created_at FROM j LEFT JOIN p USING (job_id)""",
)
def _(t):
    return A.job_history(t("jobs"), t("job_events"))


@query("aux_78_blocking_jobs", f"SELECT DISTINCT ON (id) id, kind, {_STATUS.format('status')} AS status FROM jobs WHERE id IS NOT NULL AND {_STATUS.format('status')} IN ('failed', 'indexing', 'queued')")
def _(t):
    return A.blocking_jobs(t("jobs"))


@query(
    "aux_80_missing_jobs",
    f"""WITH {_ONE}, n AS (SELECT TRY_CAST({_JSON.format('job_id')} AS BIGINT) AS job_id FROM e1), d AS (SELECT DISTINCT id FROM jobs WHERE id IS NOT NULL AND {_STATUS.format('status')} = 'succeeded')
SELECT job_id, count(*) AS edges FROM n WHERE job_id IS NOT NULL AND job_id NOT IN (FROM d) GROUP BY 1""",
)
def _(t):
    return A.missing_jobs(t("edges"), t("jobs"))


@query(
    "frs_05_extractor_provenance",
    f"""WITH {_ONE}, x AS (SELECT stage, coalesce({_JSON.format('extractor')} <> '', false) x FROM e1), g AS (SELECT stage, count(*) AS edges, count(*) FILTER (WHERE x) AS with_extractor FROM x GROUP BY 1)
SELECT *, CASE WHEN with_extractor = edges THEN 'pass' WHEN with_extractor > 0 THEN 'partial' ELSE 'fail' END AS verdict FROM g""",
)
def _(t):
    return A.extractor_provenance(t("edges"))


@query(
    "aux_76_job_kinds",
    f"""WITH {_ONE}, k AS (SELECT id, min(kind) kind FROM jobs WHERE id IS NOT NULL GROUP BY 1), n AS (SELECT stage, TRY_CAST({_JSON.format('job_id')} AS BIGINT) AS j FROM e1)
SELECT stage, kind, count(*) AS edges FROM n LEFT JOIN k ON k.id = n.j GROUP BY 1, 2""",
)
def _(t):
    return A.kinds_of_jobs(t("edges"), t("jobs"))


@query(
    "aux_86_gate",
    f"""WITH {_ONE}, g AS (SELECT stage, CASE WHEN count(*) FILTER (WHERE {_JSON.format('extractor')} <> '') = count(*) THEN 'pass' WHEN count(*) FILTER (WHERE {_JSON.format('extractor')} <> '') > 0 THEN 'partial' ELSE 'fail' END s FROM e1 GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (WHERE s = 'pass') AS passed, count(*) FILTER (WHERE s = 'partial') AS partial, count(*) FILTER (WHERE s = 'fail') AS failed, CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE s = 'pass') = count(*) THEN 'pass' ELSE 'blocked' END AS gate FROM g""",
)
def _(t):
    return A.verdicts(A.extractor_provenance(t("edges")).withColumnRenamed("verdict", "status"))


@query(
    "aux_28_last_functions",
    r"""WITH c AS (SELECT DISTINCT id, regexp_replace(text, '(?m)^\s*\d+:\s?', '', 'g') t FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL)
SELECT id, coalesce(list_last(regexp_extract_all(t, '(?m)^[A-Za-z_][\w \t*]*?[ \t*]([A-Za-z_]\w*)[ \t]*\([^;{}]*\)\s*\{', 1)), '') AS function FROM c""",
)
def _(t):
    return t("chunks").where("id is not null and text is not null").select("id", C.last_function(F.col("text")).alias("function")).distinct()


@query("aux_44_receiver_leaves", r"SELECT DISTINCT path, regexp_extract(regexp_replace(path, '\[[^\]]*\]', '', 'g'), '(\w+)\s*$', 1) AS leaf, regexp_matches(lower(name), '(funcs|ops|callbacks|func)$|_ip_block(_version)?$') AS looks_like_table FROM function_locations WHERE path IS NOT NULL AND name IS NOT NULL")
def _(t):
    f = t("function_locations").where("path is not null and name is not null")
    return f.select("path", C.receiver_leaf(F.col("path")).alias("leaf"), C.is_callback_table(F.col("name")).alias("looks_like_table")).distinct()


@query(
    "grf_11_chunk_functions",
    """WITH c AS (SELECT DISTINCT id, document_id, line_end FROM chunks WHERE id IS NOT NULL AND document_id IS NOT NULL AND line_end IS NOT NULL),
f AS (SELECT DISTINCT document_id, line_start first_line, name FROM function_locations WHERE document_id IS NOT NULL AND line_start IS NOT NULL AND name IS NOT NULL)
SELECT c.id, arg_max(f.name, (f.first_line, f.name)) AS function FROM c JOIN f ON f.document_id = c.document_id AND f.first_line <= c.line_end AND f.first_line >= c.line_end - 800 GROUP BY 1""",
)
def _(t):
    c = t("chunks").where("id is not null").select("id", F.col("document_id").cast("string").alias("path"), F.col("line_end").alias("line_start")).distinct()
    f = t("function_locations").select(F.col("document_id").cast("string").alias("path"), "line_start", "name")
    return G.enclosing_functions(c, f)
