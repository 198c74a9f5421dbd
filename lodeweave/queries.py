"""Queries of the core operators over whole tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import symbols as S
from .functions import vectors as X
from .functions import vocab as V
from .operators import codegraph as C
from .operators import evidence as E
from .operators import graph as G
from .operators import jobs as J
from .operators import orphans, semantic
from .operators import retrieval as R
from .session import ship, table, written
from .sources.files import glob_pattern, low_signal
from .sources.sinks import without_corpus


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(tables) under a name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(_Tables(ship(spark), sf_dir))
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _case(col: str, groups: dict[str, list[str]], rest: str) -> str:
    whens = " ".join(f"WHEN {col} IN ({', '.join(repr(x) for x in names)}) THEN '{k}'" for k, names in groups.items())
    return f"CASE {whens} ELSE {rest} END"


_NAME = "trim(regexp_replace(lower(relation), '[^a-z0-9]+', '_', 'g'), '_')"
_REL = f"CASE WHEN relation IS NULL OR {_NAME} IN ({', '.join(map(repr, V.PROVENANCE_RELATIONS))}) THEN NULL ELSE {_case(_NAME, V.RELATION_ALIASES, repr('relates_to'))} END"
_STATUS = "CASE WHEN lower(trim({0})) IN ('running', 'started', 'in_progress', 'indexing') THEN 'indexing' WHEN lower(trim({0})) IN ('error', 'failed') THEN 'failed' WHEN lower(trim({0})) IN ('queued', 'superseded') THEN lower(trim({0})) ELSE 'succeeded' END"
_SOURCE = "CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(path), '[.](md|rst|txt)$') THEN 'doc' WHEN lower(path) LIKE '%.h' AND (lower(path) LIKE '%/asic_reg/%' OR lower(path) LIKE '%/register%' OR regexp_matches(lower(path), '(_offset|_sh_mask|_d)[.]h$')) THEN 'register' ELSE 'code' END"
_BLOCK = "CASE " + " ".join(f"WHEN contains(upper({{0}}), '{b}') THEN '{b}'" for b in V.IP_BLOCKS) + " ELSE '' END"
_EDGES = f"""ce AS (SELECT DISTINCT id, trim(src) src, trim(dst) dst, {_REL} relation, confidence, stage, source, path, line_start, line_end, provenance_json FROM edges WHERE trim(src) <> '' AND trim(dst) <> ''),
e AS (SELECT * FROM ce WHERE relation IS NOT NULL)"""
_WEIGHTED = _EDGES + """,
g AS (SELECT src, dst, relation, count(*) AS count, avg(round(greatest(0.05, least(1.0, CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END)), 6)) a, min(stage) s0, max(stage) s1,
  list_sort(list_distinct(list(trim(source)) FILTER (WHERE trim(source) <> ''))) sources FROM e GROUP BY 1, 2, 3),
w AS (SELECT src, dst, relation, count, round(least(1.0, a), 4) AS confidence, round(least(1.0, a + CASE WHEN count > 1 THEN least(0.35, ln(1 + count) / 12) ELSE 0 END), 4) AS weight, CASE WHEN s0 = s1 THEN s0 ELSE 'mixed' END AS stage, coalesce(sources, []) AS sources FROM g)"""
_IDENT = S.IDENTIFIER.replace("?:", "")
_WRAP = "regexp_matches(symbol, '^(RREG|WREG|SOC15_REG_|amdgv_wreg|amdgv_rreg|REG_FIELD_)|^(REG_SET_FIELD|REG_GET_FIELD)$')"
_ISSYM = f"(NOT {_WRAP} AND symbol NOT IN ('static', 'void', 'uint32_t', 'return', 'data') AND (contains(symbol, '_') OR regexp_matches(symbol, '^(reg|mm)') OR (regexp_matches(symbol, '[A-Z]') AND NOT regexp_matches(symbol, '[a-z]'))))"
_HEAD = f"(NOT {_WRAP} AND length(symbol) > 2 AND lower(symbol) NOT IN ({', '.join(map(repr, S.HEADER_STOP))}) AND NOT contains(symbol, '->') AND (regexp_matches(symbol, '^(reg|mm|smn)[A-Z]') OR (regexp_matches(symbol, '^[A-Z][A-Z0-9_]*$') AND ((contains(symbol, '__') AND regexp_matches(symbol, '_(MASK|SHIFT|DEFAULT)$')) OR (contains(symbol, '_') AND regexp_matches(symbol, '{S.HEADER_HINTS}'))))))"
_ENTITY = f"CASE WHEN contains(symbol, '->') THEN 'context' WHEN regexp_matches(symbol, '{V.FIELD_NAME}') THEN 'field' WHEN regexp_matches(symbol, '^(WREG|RREG|REG_)') THEN 'macro' WHEN regexp_matches(symbol, '^(reg|mm|smn)|{V.REGISTER_NAME}') THEN 'register' ELSE 'function' END"
_CHUNKS = f"""d AS (SELECT id document_id, arg_max(path, (indexed_at, path)) path, arg_max(repo, (indexed_at, path)) repo, arg_max(corpus_id, (indexed_at, path)) corpus_id FROM source_documents WHERE id IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT ON (id) id, document_id, text, line_start, page FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
r AS (SELECT c.*, path, repo, corpus_id, {_SOURCE} source_type FROM c JOIN d USING (document_id)),
s AS (SELECT DISTINCT id, symbol, source_type FROM (SELECT id, source_type, unnest(regexp_extract_all(text, '[A-Za-z_][0-9A-Za-z_]*(->[A-Za-z_][0-9A-Za-z_]*)*')) symbol FROM r) WHERE CASE WHEN source_type = 'register' THEN {_HEAD} ELSE {_ISSYM} END)"""
_EVIDENCE = _CHUNKS + f""",
an AS (SELECT *, split_part(path, '/', -1) || CASE WHEN source_type = 'pdf' THEN '#page=' || coalesce(nullif(page, 0), 1) ELSE '' END symbol FROM r WHERE source_type IN ('doc', 'pdf') AND regexp_matches(text, '\\S') AND id NOT IN (SELECT id FROM s)),
x AS (SELECT r.*, symbol, CASE WHEN r.source_type = 'register' THEN CASE WHEN regexp_matches(symbol, '{V.FIELD_NAME}') THEN 'field' WHEN regexp_matches(symbol, '^(WREG|RREG|REG_)') THEN 'macro' WHEN {_HEAD} THEN 'register' ELSE {_ENTITY} END ELSE {_ENTITY} END entity_type FROM s JOIN r USING (id)),
ev AS (SELECT id chunk_id, document_id, path, source_type, symbol, page, line_start, entity_type,
  CASE WHEN contains(text, 'REG_SET_FIELD') THEN CASE WHEN {_ENTITY} = 'field' THEN 'field_set' ELSE 'read_modify_write' END
       WHEN len(list_filter(regexp_extract_all(text, '\\bWREG[0-9A-Z_]*\\s*\\(([^)]*)', 1), lambda a: contains(a, symbol))) > 0 THEN 'write'
       WHEN len(list_filter(regexp_extract_all(text, '\\bRREG[0-9A-Z_]*\\s*\\(([^)]*)', 1), lambda a: contains(a, symbol))) > 0 THEN 'read' ELSE 'mention' END access_type,
  {_BLOCK.format("symbol || ' ' || path")} ip_block,
  CASE WHEN list_contains(regexp_extract_all(text, '[0-9A-Za-z_]+'), split_part(symbol, '->', 1)) AND list_contains(regexp_extract_all(text, '[0-9A-Za-z_]+'), split_part(symbol, '->', -1)) THEN 0.95 ELSE 0.75 END confidence FROM x
  UNION ALL SELECT id, document_id, path, source_type, symbol, page, line_start, CASE WHEN {_ISSYM} THEN {_ENTITY} WHEN source_type = 'pdf' THEN 'pdf_page' ELSE 'doc_section' END, 'mention',
  {_BLOCK.format("symbol || ' ' || path")}, CASE WHEN regexp_matches(text, '\\b' || regexp_escape(symbol) || '\\b') THEN 0.95 ELSE 0.75 END FROM an)"""

# ---------------------------------------------------------------- references (problem 3)

_REFS = """
WITH refs AS (
  SELECT 'chunks' ref_table, 'document_id' ref_field, id row_id, 'source_documents' parent, CAST(document_id AS VARCHAR) k, ingested_at t FROM chunks
  UNION ALL SELECT 'job_events', 'job_id', id, 'jobs', CAST(job_id AS VARCHAR), created_at FROM job_events
  UNION ALL SELECT 'edges', 'src', id, 'graph_nodes', trim(src), ingested_at FROM edges
  UNION ALL SELECT 'edges', 'dst', id, 'graph_nodes', trim(dst), ingested_at FROM edges),
lives AS (
  SELECT 'source_documents' parent, CAST(id AS VARCHAR) k, indexed_at born, deleted_at died FROM source_documents
  UNION ALL SELECT 'jobs', CAST(id AS VARCHAR), started_at, NULL FROM jobs
  UNION ALL SELECT 'graph_nodes', trim(id), created_at, deleted_at FROM graph_nodes),
orphans AS (
  SELECT DISTINCT * FROM refs r WHERE k IS NOT NULL AND k <> '' AND NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.parent = r.parent AND l.k = r.k AND l.born <= r.t AND (l.died IS NULL OR l.died > r.t)))
"""
query("p3_found", _REFS + "SELECT DISTINCT ref_table, ref_field, row_id FROM orphans")(lambda t: orphans.found(t.spark, t.sf_dir))
query("p3_monthly", _REFS + "SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(DISTINCT row_id) AS orphans FROM orphans GROUP BY ALL")(lambda t: orphans.monthly(t.spark, t.sf_dir))
query("p3_snapshot")(lambda t: orphans.snapshot(t.spark, t.sf_dir))

# ---------------------------------------------------------------- sources


@query("src_07_source_types", f"SELECT DISTINCT id, path, {_SOURCE} AS source_type FROM source_documents")
def _(t):
    return t("source_documents").select("id", "path", V.source_type(F.col("path")).alias("source_type")).distinct()


@query(
    "src_08_line_chunks",
    """WITH l AS (SELECT DISTINCT doc_id, string_split(text, chr(10)) l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) n FROM l)
SELECT doc_id, CAST((n - 1) // 40 AS INT) AS chunk, CAST(min(n) AS INT) AS line_start, CAST(max(n) AS INT) AS line_end, md5(string_agg(n || ': ' || line, chr(10) ORDER BY n)) AS text_md5 FROM u GROUP BY 1, 2""",
)
def _(t):
    return E.chunk_lines(t("documents"), "doc_id", "text").withColumn("text_md5", F.md5("text")).drop("text")


@query("src_03_include_glob", "SELECT DISTINCT id, path FROM source_documents WHERE regexp_matches(path, '(^|/)drivers/gpu/[^/]*/[^/]*[.][ch]$')")
def _(t):
    return t("source_documents").where(F.col("path").rlike(glob_pattern("drivers/gpu/*/*.[ch]"))).select("id", "path").distinct()


@query("src_02_low_signal", "SELECT count(*) AS files FROM (SELECT DISTINCT path FROM source_documents WHERE NOT regexp_matches(lower(path), '/ucode/[^/]*[.]h$|ucode[^/]*_signed[.][hc]$'))")
def _(t):
    return t("source_documents").where(~low_signal(F.col("path"))).agg(F.countDistinct("path").alias("files"))


# ---------------------------------------------------------------- symbols and evidence


@query("ext_01_identifiers", "WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL) SELECT symbol, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][0-9A-Za-z_]*(->[A-Za-z_][0-9A-Za-z_]*)*')) symbol FROM c) GROUP BY 1")
def _(t):
    c = t("chunks").where("text is not null").select("id", "text").dropDuplicates(["id"])
    return c.select(F.explode(E.identifiers(F.col("text"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("ext_02_symbols", f"WITH {_CHUNKS} SELECT id, symbol FROM s")
def _(t):
    return E.chunk_symbols(E.chunk_rows(t("chunks"), t("source_documents"))).select("id", "symbol")


@query("ext_04_evidence", f"WITH {_EVIDENCE} SELECT chunk_id, symbol, source_type, entity_type, access_type, ip_block, CAST(confidence AS DOUBLE) AS confidence FROM ev")
def _(t):
    return E.evidence(t("chunks"), t("source_documents"), False).select("chunk_id", "symbol", "source_type", "entity_type", "access_type", "ip_block", "confidence")


@query(
    "ext_05_evidence_totals",
    f"WITH {_EVIDENCE} SELECT source_type, entity_type, access_type, ip_block, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM ev GROUP BY ALL",
)
def _(t):
    return E.evidence(t("chunks"), t("source_documents"), False).groupBy("source_type", "entity_type", "access_type", "ip_block").agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"))


@query("ext_09_snippets")
def _(t):
    return E.evidence(t("chunks"), t("source_documents")).select("chunk_id", "symbol", "confidence", "snippet", "resolved_chain")


@query("agg_09_doc_candidates", f"WITH {_EVIDENCE} SELECT chunk_id, count(*) AS evidence, count(*) FILTER (WHERE entity_type = 'register') AS registers, count(*) FILTER (WHERE entity_type = 'function') AS functions FROM ev WHERE source_type IN ('doc', 'pdf') GROUP BY 1")
def _(t):
    return E.doc_candidates(E.evidence(t("chunks"), t("source_documents"), False))


@query("grf_10_cooccurrence")
def _(t):
    return E.cooccurrence(E.evidence(t("chunks"), t("source_documents"), False))


# ---------------------------------------------------------------- scalars


@query("scl_01_relations", "SELECT relation, " + _REL + " AS normalised, count(DISTINCT id) AS edges FROM edges GROUP BY ALL")
def _(t):
    return t("edges").groupBy("relation", V.relation(F.col("relation")).alias("normalised")).agg(F.countDistinct("id").alias("edges"))


@query(
    "scl_02_node_kinds",
    "SELECT kind, CASE WHEN lower(kind) IN ('function', 'func') THEN 'function' WHEN lower(kind) = 'register' THEN 'register' WHEN lower(kind) = 'doc' THEN 'doc' ELSE 'code' END AS graph_kind, count(DISTINCT id) AS nodes FROM graph_nodes GROUP BY ALL",
)
def _(t):
    return t("graph_nodes").groupBy("kind", V.graph_kind(F.col("kind")).alias("graph_kind")).agg(F.countDistinct("id").alias("nodes"))


@query(
    "scl_03_symbol_kinds",
    f"SELECT DISTINCT label, CASE WHEN regexp_matches(lower(label), '[.](md|rst|txt|pdf)#box-') THEN 'doc_box' WHEN regexp_matches(lower(label), '[.](md|rst|txt)#') THEN 'doc_section' WHEN contains(lower(label), '.pdf#') THEN 'pdf_section' WHEN regexp_matches(lower(label), '[.](md|rst|txt)$') THEN 'doc' WHEN lower(label) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(label, '{V.FIELD_NAME}|FIELD') THEN 'field' WHEN regexp_matches(label, '^CP_HQD_|^(reg|mm|smn)[A-Z]|CNTL|CONTROL|STATUS|RESET|BASE|SIZE|VMID|DOORBELL|QUEUE|REGISTER') THEN 'register' ELSE 'code' END AS kind FROM graph_nodes WHERE label IS NOT NULL",
)
def _(t):
    return t("graph_nodes").where("label is not null").select("label", V.kind_from_symbol(F.col("label")).alias("kind")).distinct()


@query("scl_04_registers", f"WITH {_CHUNKS} SELECT DISTINCT symbol, regexp_replace(symbol, '^(reg|mm|smn)([A-Z])', '\\2') AS register FROM s")
def _(t):
    return E.chunk_symbols(E.chunk_rows(t("chunks"), t("source_documents"))).select("symbol", V.canonical_register(F.col("symbol")).alias("register")).distinct()


@query("scl_09_headings", "SELECT DISTINCT id, trim(regexp_extract(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)^(\\d+: )?#{1,6}[ \\t]+(.+)$', 2)) AS heading FROM chunks WHERE text IS NOT NULL")
def _(t):
    return t("chunks").where("text is not null").select("id", V.heading(F.col("text")).alias("heading")).distinct()


@query("scl_15_cosine", "WITH a AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), q AS (SELECT v FROM a WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(a.v, q.v), 5) AS score FROM a, q")
def _(t):
    e = t("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("_q")), 5).alias("score"))


@query(
    "scl_16_deterministic_embedding",
    "WITH d AS (SELECT DISTINCT doc_id, sha256(text) h FROM documents WHERE text IS NOT NULL) SELECT doc_id, "
    + ", ".join(f"round(CAST('0x' || substr(h, {2 * i + 1}, 2) AS INT) / 255.0 * 2 - 1, 6) AS v{i}" for i in range(8))
    + " FROM d",
)
def _(t):
    d = t("documents").where("text is not null").select("doc_id", X.deterministic_embedding(F.col("text")).alias("v")).distinct()
    return d.select("doc_id", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(8)])


@query("scl_20_job_status", f"SELECT status, {_STATUS.format('status')} AS normalised, count(DISTINCT id) AS jobs FROM jobs GROUP BY ALL")
def _(t):
    return t("jobs").groupBy("status", V.job_status(F.col("status")).alias("normalised")).agg(F.countDistinct("id").alias("jobs"))


# ---------------------------------------------------------------- retrieval

_QUESTION = "Which functions write the SDMA ring status register?"
_TOKENS = R.query_tokens(_QUESTION)


def _phrase_sql(tokens: list[str]) -> str:
    folded = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
    return " OR ".join(f"contains({folded}, '{S.phrase(x)}')" for x in tokens)


@query("ret_01_phrase_match", f"SELECT DISTINCT id FROM chunks WHERE text IS NOT NULL AND ({_phrase_sql(['ring_buffer', 'guard page', 'sdma'])})")
def _(t):
    return R.phrase_match(t("chunks"), ["ring_buffer", "guard page", "sdma"])


@query(
    "ret_02_vector_top_k",
    "WITH a AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), q AS (SELECT v FROM a WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(a.v, q.v), 6) AS score FROM a, q ORDER BY score DESC, vec_id LIMIT 20",
)
def _(t):
    row = t("embeddings").where("vec_id = 7").select("embedding").first()
    return R.vector_top(t("embeddings"), "vec_id", "embedding", list(row.embedding) if row else [0.0], 20)


@query("ret_08_scored_evidence")
def _(t):
    return R.query_evidence(E.evidence(t("chunks"), t("source_documents")), t("chunks"), _QUESTION, None).select("chunk_id", "symbol", "score", "rank_score")


@query("ret_15_query_evidence")
def _(t):
    return R.query_evidence(E.evidence(t("chunks"), t("source_documents")), t("chunks"), _QUESTION)


@query("ret_11_diverse_evidence")
def _(t):
    rows = written(R.query_evidence(E.evidence(t("chunks"), t("source_documents")), t("chunks"), _QUESTION, None), "ranked")
    return R.diversified(rows, 24)


@query("ret_12_prefix_query")
def _(t):
    return R.query_evidence(E.evidence(t("chunks"), t("source_documents")), t("chunks"), "who reads SDMA_RING* registers", None).select("chunk_id", "symbol", "access_type", "rank_score")


# ---------------------------------------------------------------- graph


def _weighted(t) -> DataFrame:
    return G.weighted(G.clean_edges(t("edges")))


query("agg_01_edge_weights", f"WITH {_WEIGHTED} SELECT src, dst, relation, count, confidence, weight, stage FROM w")(lambda t: _weighted(t).drop("sources"))


@query("agg_02_edge_sources", f"WITH {_WEIGHTED} SELECT src, dst, relation, array_to_string(sources, '|') AS sources FROM w")
def _(t):
    return _weighted(t).select("src", "dst", "relation", F.array_join("sources", "|").alias("sources"))


@query("agg_03_node_weights", f"WITH {_WEIGHTED}, n AS (SELECT src node, weight FROM w UNION ALL SELECT dst, weight FROM w) SELECT node, CAST(sum(CAST(weight AS DECIMAL(20, 4))) AS DOUBLE) AS weight, count(*) AS edges FROM n GROUP BY 1")
def _(t):
    return G.node_weights(_weighted(t)).select("node", "weight", "edges")


@query(
    "agg_06_concept_overlap",
    f"""WITH {_WEIGHTED}, u AS (SELECT DISTINCT src, dst, regexp_replace(split_part(src, ':', -1), '_[0-9a-z][0-9a-z]$', '') concept FROM w WHERE relation IN ('reads', 'writes', 'sets_field', 'maps_base') AND src LIKE 'function:%' AND dst LIKE 'register:%'),
n AS (SELECT concept, src, list(DISTINCT dst) r FROM u GROUP BY 1, 2),
p AS (SELECT x.concept, len(list_intersect(x.r, y.r)) / len(list_distinct(list_concat(x.r, y.r))) j FROM n x JOIN n y ON x.concept = y.concept AND x.src < y.src),
l AS (SELECT concept, round(min(j), 4) AS overlap FROM p GROUP BY 1)
SELECT concept, (SELECT count(*) FROM n WHERE n.concept = l.concept) AS implementations, overlap, CASE WHEN overlap < 0.10 THEN 'split_recommended' WHEN overlap < 0.35 THEN 'divergent' ELSE 'merged' END AS merge_status FROM l""",
)
def _(t):
    return G.concept_overlap(_weighted(t))


query("agg_16_stage_counts", f"WITH {_EDGES} SELECT stage, source, count(*) AS edges FROM e GROUP BY ALL")(lambda t: G.clean_edges(t("edges")).groupBy("stage", "source").agg(F.count("*").alias("edges")))
query("agg_10_distinct_counts", "SELECT count(DISTINCT id) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT page) AS pages FROM chunks")(
    lambda t: t("chunks").agg(F.countDistinct("id").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("page").alias("pages"))
)


@query("agg_11_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("source_documents", "chunks", "edges", "jobs", "job_events", "graph_nodes", "embeddings")))
def _(t):
    parts = [t(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in ("source_documents", "chunks", "edges", "jobs", "job_events", "graph_nodes", "embeddings")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("agg_14_fan_out", f"WITH {_EDGES} SELECT src, count(*) AS targets FROM (SELECT DISTINCT src, dst FROM e WHERE relation = 'calls') GROUP BY 1 ORDER BY targets DESC, src LIMIT 20")
def _(t):
    calls = G.clean_edges(t("edges")).where("relation = 'calls'").select("src", "dst").distinct()
    return calls.groupBy("src").agg(F.count("*").alias("targets")).orderBy(F.desc("targets"), "src").limit(20)


@query("grf_12_edge_order", f"WITH {_WEIGHTED} SELECT src, dst, relation, row_number() OVER (ORDER BY CASE WHEN relation IN ('reads', 'writes', 'sets_field', 'maps_base', 'calls') THEN 0 WHEN relation IN ('contains', 'documents', 'configures', 'resets', 'depends_on') THEN 1 ELSE 2 END, weight DESC, count DESC, confidence DESC, src, dst, relation) AS place FROM w QUALIFY place <= 3000")
def _(t):
    top = _weighted(t)
    top = top.orderBy(*G.ordered(top)).limit(3000)
    return top.withColumn("place", F.row_number().over(W.orderBy(*G.ordered(top)))).select("src", "dst", "relation", "place")


_SEED = "function:"


def _seeds(t) -> DataFrame:
    """The three smallest node ids of the edges: a fixed rule that any size has."""
    e = G.clean_edges(t("edges"))
    return e.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").startswith("register:")).distinct().orderBy("node").limit(3)


_HOPS = f"""WITH RECURSIVE {_WEIGHTED}, b AS (SELECT src a, dst b FROM w UNION SELECT dst, src FROM w),
seed AS (SELECT node FROM (SELECT src node FROM w UNION SELECT dst FROM w) WHERE node LIKE 'register:%' ORDER BY node LIMIT 3),
h AS (SELECT node, 0 hop FROM seed UNION SELECT b.b, hop + 1 FROM h JOIN b ON b.a = h.node WHERE hop < 2),
m AS (SELECT node, CAST(min(hop) AS INT) AS hop FROM h GROUP BY 1)
"""


@query("grf_03_neighbourhood", _HOPS + "SELECT node, hop FROM m")
def _(t):
    return G.expand(G.clean_edges(t("edges")), _seeds(t), 2)


@query("grf_03_touched_edges", _HOPS + "SELECT DISTINCT src, dst, relation FROM w WHERE src IN (SELECT node FROM m WHERE hop < 2) OR dst IN (SELECT node FROM m WHERE hop < 2)")
def _(t):
    w = _weighted(t)
    return G.touched_edges(w, G.expand(w, _seeds(t), 2), 2).select("src", "dst", "relation")


@query("grf_04_induced_edges", _HOPS + "SELECT DISTINCT src, dst, relation FROM w WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)")
def _(t):
    w = _weighted(t)
    return G.induced_edges(w, G.expand(w, _seeds(t), 2)).select("src", "dst", "relation")


@query("grf_15_bridges", f"""WITH {_WEIGHTED}, o AS (SELECT *, split_part(src, ':', 2) scope FROM w WHERE relation IN ('reads', 'writes', 'sets_field', 'maps_base') AND src LIKE 'function:%' AND dst LIKE 'register:%'),
r AS (SELECT dst, count(DISTINCT scope) scopes, sum(count) uses FROM o GROUP BY 1 HAVING count(DISTINCT scope) > 1)
SELECT o.dst AS register, scope, src, relation, weight, scopes, CAST(uses AS BIGINT) AS uses FROM o JOIN r ON r.dst = o.dst QUALIFY row_number() OVER (PARTITION BY o.dst, scope ORDER BY weight DESC, count DESC, src, relation) = 1""")
def _(t):
    return G.bridges(_weighted(t))


@query("grf_16_call_components")
def _(t):
    return G.call_components(_weighted(t))


@query("grf_17_spanning_forest")
def _(t):
    return G.spanning_forest(_weighted(t)).select("src", "dst", "weight")


@query("grf_13_budgeted_graph")
def _(t):
    return G.budgeted(_weighted(t), 3000)


@query("jon_09_nearby_edges", f"""WITH {_EDGES}, k AS (SELECT id, path, line_start, greatest(line_start, coalesce(line_end, line_start)) line_end FROM e WHERE stage = 'deterministic' AND path IS NOT NULL AND line_start IS NOT NULL)
SELECT a.id, b.id AS near_id, abs(b.line_start - a.line_start) AS distance FROM k a JOIN k b ON a.path = b.path AND a.id <> b.id AND b.line_start BETWEEN a.line_start - 2 AND a.line_end + 2 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(b.line_start - a.line_start), b.id) <= 80""")
def _(t):
    return G.nearby(G.clean_edges(t("edges")))


@query("jon_07_chunks_without_embedding", "SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = id)")
def _(t):
    return t("chunks").where("id is not null").select("id").distinct().join(t("embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")


@query("jon_12_unique_functions", "SELECT name, min(document_id) AS document_id FROM (SELECT DISTINCT name, document_id, line_start FROM function_locations WHERE name IS NOT NULL) GROUP BY 1 HAVING count(*) = 1")
def _(t):
    f = t("function_locations").where("name is not null").select("name", "document_id", "line_start").distinct()
    return f.groupBy("name").agg(F.min("document_id").alias("document_id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")


@query("jon_13_nodes_of_edges", f"WITH {_EDGES} SELECT e.id, n.label FROM e LEFT JOIN (SELECT id, max(label) AS label FROM graph_nodes GROUP BY 1) n ON n.id = e.dst")
def _(t):
    n = t("graph_nodes").groupBy(F.col("id").alias("dst")).agg(F.max("label").alias("label"))
    return G.clean_edges(t("edges")).join(n, "dst", "left").select("id", "label")


# ---------------------------------------------------------------- jobs, policy, sinks

_JOBS = f"j AS (SELECT DISTINCT id, kind, {_STATUS.format('status')} status, metadata_json, started_at, finished_at FROM jobs WHERE id IS NOT NULL)"
query("agg_12_latest_jobs", f"WITH {_JOBS} SELECT kind, max(id) AS job_id FROM j WHERE status = 'succeeded' GROUP BY 1")(lambda t: J.latest_succeeded(t("jobs")))
query("frs_01_floor", f"WITH {_JOBS} SELECT max(id) AS floor FROM j WHERE status = 'succeeded' AND kind IN ('index', 'graph_rebuild')")(lambda t: J.freshness_floor(t("jobs")))


@query("frs_03_usable_edges", f"""WITH {_EDGES}, {_JOBS},
v AS (SELECT id FROM j WHERE status = 'succeeded' AND kind IN ('semantic_edges', 'semantic_edges_batch', 'doc_nodes_batch') AND json_valid(metadata_json) AND CASE WHEN json_valid(metadata_json) THEN metadata_json ->> '$.provider_settings.edge.provider' END = 'local' AND CASE WHEN json_valid(metadata_json) THEN metadata_json ->> '$.provider_settings.edge.model' END = 'm2'),
f AS (SELECT max(id) floor FROM j WHERE status = 'succeeded' AND kind IN ('index', 'graph_rebuild')),
q AS (SELECT e.*, CASE WHEN json_valid(provenance_json) THEN try_cast(provenance_json ->> '$.job_id' AS BIGINT) END job_id FROM e)
SELECT stage, count(*) AS edges FROM q, f WHERE stage = 'deterministic' OR (stage = 'semantic' AND job_id IN (SELECT id FROM v) AND coalesce(floor, 0) <= job_id) OR stage IS NULL OR stage NOT IN ('deterministic', 'semantic', 'evidence') GROUP BY 1""")
def _(t):
    return J.usable_edges(G.clean_edges(t("edges")), t("jobs"), "local", "m2").groupBy("stage").agg(F.count("*").alias("edges"))


@query("frs_06_supersede", f"WITH {_JOBS}, k AS (SELECT max(id) newest FROM j WHERE kind = 'index') SELECT id, kind, CASE WHEN kind = 'index' AND id < newest AND status IN ('queued', 'indexing', 'failed') THEN 'superseded' ELSE status END AS status FROM j, k")
def _(t):
    newest = t("jobs").where("kind = 'index'").agg(F.max("id").alias("m")).first().m or 0
    return J.supersede(t("jobs"), "index", newest)


@query("frs_07_lifecycle", f"""WITH v AS (SELECT DISTINCT id, job_id, {_STATUS.format('status')} status FROM job_events WHERE id IS NOT NULL AND job_id IS NOT NULL),
p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY id) p FROM v)
SELECT job_id, string_agg(status, ' -> ' ORDER BY id) FILTER (WHERE p IS NULL OR p <> status) AS lifecycle, arg_max(status, id) AS last_status, count(*) AS events FROM p GROUP BY 1""")
def _(t):
    return J.lifecycle(t("job_events"))


@query("snk_03_upsert", f"""WITH {_JOBS}, l AS (SELECT job_id, arg_max({_STATUS.format('status')}, id) status FROM (SELECT DISTINCT id, job_id, status FROM job_events WHERE job_id IS NOT NULL) GROUP BY 1)
SELECT coalesce(l.job_id, j.id) AS id, coalesce(l.status, j.status) AS status FROM j FULL JOIN l ON l.job_id = j.id""")
def _(t):
    current = J.clean_jobs(t("jobs")).select("id", "status", F.col("id").alias("seq"))
    changes = t("job_events").where("job_id is not null and id is not null").select(F.col("job_id").alias("id"), V.job_status(F.col("status")).alias("status"), F.col("id").alias("seq"))
    return J.upsert(current, changes, "id", F.col("seq")).drop("seq")


@query("snk_06_delete_stage", f"""WITH {_EDGES} SELECT count(*) AS edges FROM e WHERE NOT (stage IS NOT DISTINCT FROM 'deterministic' AND coalesce(CASE WHEN json_valid(provenance_json) THEN provenance_json ->> '$.corpus_id' END, '') IN ('vexa-mxvirt', 'orb-kernel'))""")
def _(t):
    corpus = F.coalesce(F.get_json_object("provenance_json", "$.corpus_id"), F.lit(""))
    gone = (F.coalesce("stage", F.lit("")) == "deterministic") & corpus.isin("vexa-mxvirt", "orb-kernel")
    return G.clean_edges(t("edges")).where(~gone).agg(F.count("*").alias("edges"))


@query("agg_17_coverage", "WITH c AS (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL), g AS (SELECT count(*) AS chunks, count(v) AS embedded FROM c LEFT JOIN (SELECT DISTINCT vec_id v FROM embeddings) ON v = id) SELECT chunks, embedded, chunks - embedded AS missing, CASE WHEN chunks = embedded THEN 'pass' WHEN embedded > 0 THEN 'partial' ELSE 'fail' END AS verdict FROM g")
def _(t):
    return J.embedding_coverage(t("chunks"), t("embeddings"), "vec_id")


query("cli_01_stage_histogram", "SELECT coalesce(nullif(trim(stage), ''), 'unspecified') AS stage, count(DISTINCT id) AS edges FROM edges GROUP BY 1")(
    lambda t: t("edges").groupBy(F.coalesce(F.nullif(F.trim("stage"), F.lit("")), F.lit("unspecified")).alias("stage")).agg(F.countDistinct("id").alias("edges"))
)
query("cli_10_index_status", f"WITH {_JOBS} SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('indexing', 'queued')) THEN 'indexing' WHEN bool_or(status = 'succeeded') THEN 'ready' ELSE 'not indexed' END AS index_status FROM j")(lambda t: J.index_status(t("jobs")))
query("agg_13_event_histogram", f"SELECT strftime(created_at, '%Y-%m') AS month, {_STATUS.format('status')} AS status, count(DISTINCT id) AS events FROM job_events GROUP BY ALL")(
    lambda t: t("job_events").groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), V.job_status(F.col("status")).alias("status")).agg(F.countDistinct("id").alias("events"))
)


# ---------------------------------------------------------------- code graph


@query("cod_04_functions")
def _(t):
    return C.file_facts(t("chunks"), t("source_documents")).where("fact = 'function'").select("document_id", "path", "name", "line", "line_end")


@query("cod_06_call_edges")
def _(t):
    return C.call_edges(written(C.file_facts(t("chunks"), t("source_documents")), "facts"))


@query("cod_07_register_edges")
def _(t):
    return C.access_edges(C.file_facts(t("chunks"), t("source_documents")))


@query("cod_13_dispatch_edges")
def _(t):
    return C.dispatch_edges(written(C.file_facts(t("chunks"), t("source_documents")), "facts"))


@query("ext_15_resolved_symbols")
def _(t):
    return C.file_facts(t("chunks"), t("source_documents")).where("fact = 'access'").groupBy("name", "kind").agg(F.count("*").alias("uses"), F.countDistinct("document_id").alias("files"))


# ---------------------------------------------------------------- more filters, joins and projections


@query(
    "scl_05_ip_versions",
    rf"""SELECT DISTINCT path, {_BLOCK.format('path')} AS ip_block, CASE WHEN regexp_matches(path, '(v|_)(\d{{1,2}})[_.-](\d)') THEN regexp_extract(path, '(v|_)(\d{{1,2}})[_.-](\d)', 2) || '.' || regexp_extract(path, '(v|_)(\d{{1,2}})[_.-](\d)', 3) ELSE '' END AS ip_version FROM source_documents WHERE path IS NOT NULL""",
)
def _(t):
    p = F.col("path")
    return t("source_documents").where("path is not null").select("path", V.ip_block(p, F.lit("")).alias("ip_block"), V.ip_version(p).alias("ip_version")).distinct()


@query("scl_06_languages", "SELECT CASE WHEN regexp_matches(lower(path), '[.](c|h)$') THEN 'c' WHEN regexp_matches(lower(path), '[.](cc|cpp|hpp|cxx|hh)$') THEN 'cpp' WHEN lower(path) LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language, count(DISTINCT path) AS files FROM source_documents GROUP BY 1")
def _(t):
    return t("source_documents").groupBy(V.language(F.col("path")).alias("language")).agg(F.countDistinct("path").alias("files"))


@query("scl_10_repositories", "SELECT CASE WHEN length(regexp_replace(trim(repo), '[.]git/?$', '')) > 0 THEN regexp_replace(trim(repo), '[.]git/?$', '') ELSE 'unknown' END AS repo, count(DISTINCT id) AS files FROM source_documents GROUP BY 1")
def _(t):
    return t("source_documents").groupBy(V.repository(F.col("repo")).alias("repo")).agg(F.countDistinct("id").alias("files"))


@query(
    "scl_10_section_ids",
    """WITH c AS (SELECT DISTINCT ON (id) id, document_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') text, page, line_start FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT id document_id, max(path) path FROM source_documents GROUP BY 1),
s AS (SELECT c.*, path, trim(regexp_replace(lower(trim(regexp_extract(text, '(?m)^(\\d+: )?#{1,6}[ \\t]+(.+)$', 2))), '[^a-z0-9]+', '-', 'g'), '-') slug FROM c JOIN d USING (document_id))
SELECT id, path || '#' || CASE WHEN slug <> '' THEN slug WHEN page > 0 THEN 'page-' || page WHEN line_start IS NOT NULL THEN 'lines-' || line_start ELSE 'section' END AS section FROM s""".replace("\\\\", "\\"),
)
def _(t):
    d = t("source_documents").groupBy(F.col("id").alias("document_id")).agg(F.max("path").alias("path"))
    c = t("chunks").where(F.col("id").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["id"]).select("id", "document_id", "text", "page", "line_start")
    return c.join(d, "document_id").select("id", V.section_id(F.col("path"), F.col("text"), F.col("page"), F.col("line_start")).alias("section"))


@query("scl_11_function_concepts", f"WITH {_EDGES}, n AS (SELECT src node FROM e UNION SELECT dst FROM e) SELECT regexp_replace(split_part(node, ':', -1), '_[0-9a-z][0-9a-z]$', '') AS concept, count(*) AS implementations FROM n WHERE node LIKE 'function:%' GROUP BY 1")
def _(t):
    n = G.clean_edges(t("edges")).select(F.explode(F.array("src", "dst")).alias("node")).where("node like 'function:%'").distinct()
    return n.groupBy(F.regexp_replace(G.label(F.col("node")), "_[0-9a-z]{2}$", "").alias("concept")).agg(F.count("*").alias("implementations"))


@query("flt_01_wrapper_endpoints", f"WITH {_EDGES} SELECT count(*) AS edges FROM e WHERE NOT regexp_matches(split_part(src, ':', -1), '^(RREG|WREG|SOC15_REG_|REG_FIELD_)') AND NOT regexp_matches(split_part(dst, ':', -1), '^(RREG|WREG|SOC15_REG_|REG_FIELD_)')")
def _(t):
    return G.clean_edges(t("edges")).where(~S.is_wrapper(G.label(F.col("src"))) & ~S.is_wrapper(G.label(F.col("dst")))).agg(F.count("*").alias("edges"))


@query("flt_05_like_any", "SELECT DISTINCT id FROM graph_nodes WHERE lower(label) LIKE '%ring_%' OR lower(label) LIKE '%status%' OR lower(id) LIKE '%vm_%'")
def _(t):
    return t("graph_nodes").where(F.lower("label").like("%ring_%") | F.lower("label").like("%status%") | F.lower("id").like("%vm_%")).select("id").distinct()


@query("flt_06_symbol_aliases", "WITH a AS (SELECT unnest(['gc_ring_status', 'sdma_tile_config', 'rlc_port_base']) token), x AS (SELECT token AS alias FROM a UNION SELECT upper(token) FROM a UNION SELECT p || upper(token) FROM a, (SELECT unnest(['reg', 'mm', 'smn']) p)) SELECT DISTINCT id, label FROM graph_nodes n WHERE EXISTS (SELECT 1 FROM x WHERE starts_with(n.label, alias))")
def _(t):
    tokens = ["gc_ring_status", "sdma_tile_config", "rlc_port_base"]
    names = list(dict.fromkeys(a for k in tokens for a in (k, k.upper(), *(p + k.upper() for p in ("reg", "mm", "smn")))))
    return t("graph_nodes").where(R.any_of([F.col("label").startswith(a) for a in names])).select("id", "label").distinct()


@query("flt_07_meaningful_symbols", f"WITH {_CHUNKS} SELECT count(DISTINCT symbol) AS symbols FROM s WHERE length(symbol) >= 3 AND (contains(symbol, '->') OR contains(symbol, '_') OR regexp_matches(symbol, '[0-9]') OR regexp_matches(symbol, '^(reg|mm|smn)[A-Z]'))")
def _(t):
    s = E.chunk_symbols(E.chunk_rows(t("chunks"), t("source_documents")))
    return s.where("length(symbol) >= 3").where(F.col("symbol").rlike("->|_|[0-9]|^(?:reg|mm|smn)[A-Z]")).agg(F.countDistinct("symbol").alias("symbols"))


@query("flt_13_callback_pollution", f"WITH {_EDGES} SELECT id, src, dst FROM e WHERE relation = 'calls' AND (NOT regexp_matches(split_part(src, ':', -1), '^[A-Za-z_][A-Za-z0-9_]*$') OR NOT regexp_matches(split_part(dst, ':', -1), '^[A-Za-z_][A-Za-z0-9_]*$'))")
def _(t):
    bad = lambda c: ~G.label(F.col(c)).rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    return G.clean_edges(t("edges")).where((F.col("relation") == "calls") & (bad("src") | bad("dst"))).select("id", "src", "dst")


@query("jon_05_chunk_facts", f"WITH {_EVIDENCE} SELECT c.id, count(ev.symbol) AS evidence FROM c JOIN d USING (document_id) LEFT JOIN ev ON ev.chunk_id = c.id GROUP BY 1")
def _(t):
    rows = E.chunk_rows(t("chunks"), t("source_documents"))
    n = E.evidence(t("chunks"), t("source_documents"), False).groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias("_n"))
    return rows.select("id").join(n, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("evidence"))


@query("jon_15_edges_of_valid_jobs", f"WITH {_EDGES}, {_JOBS} SELECT e.id FROM e WHERE CASE WHEN json_valid(provenance_json) THEN try_cast(provenance_json ->> '$.job_id' AS BIGINT) END IN (SELECT id FROM j WHERE status = 'succeeded')")
def _(t):
    e = G.clean_edges(t("edges")).withColumn("job_id", F.expr("try_cast(get_json_object(provenance_json, '$.job_id') as bigint)"))
    return e.join(J.clean_jobs(t("jobs")).where("status = 'succeeded'").select(F.col("id").alias("job_id")), "job_id", "left_semi").select("id")


@query("agg_05_node_lines", f"""WITH {_WEIGHTED}, o AS (SELECT src node, array_to_string(list_sort(list_distinct(list(relation || ' ' || split_part(dst, ':', -1)))), '; ') outs FROM w GROUP BY 1),
i AS (SELECT dst node, array_to_string(list_sort(list_distinct(list(split_part(src, ':', -1) || ' ' || relation))), '; ') ins FROM w GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(outs, '') AS outs, coalesce(ins, '') AS ins FROM o FULL JOIN i ON i.node = o.node""")
def _(t):
    return G.node_lines(_weighted(t))


@query("agg_07_expansion_merge", f"WITH {_EDGES} SELECT src, dst, relation, stage, max(greatest(0.05, least(1.0, CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END))) AS confidence, count(*) AS count FROM e GROUP BY 1, 2, 3, 4")
def _(t):
    return G.clean_edges(t("edges")).groupBy("src", "dst", "relation", "stage").agg(F.max(V.edge_confidence(F.col("confidence"))).alias("confidence"), F.count("*").alias("count"))


@query("agg_04_node_conflicts", "WITH n AS (SELECT DISTINCT id, kind, label FROM graph_nodes) SELECT id, min(label) AS label, count(DISTINCT label) > 1 AS conflict FROM n GROUP BY 1")
def _(t):
    return t("graph_nodes").groupBy("id").agg(F.min("label").alias("label"), (F.countDistinct("label") > 1).alias("conflict"))


@query("grf_08_section_overlay", f"WITH {_EVIDENCE} SELECT path, symbol, round(CAST(max(confidence) AS DOUBLE) * 0.92, 4) AS confidence, count(*) AS mentions FROM ev WHERE source_type IN ('doc', 'pdf') GROUP BY 1, 2")
def _(t):
    ev = E.evidence(t("chunks"), t("source_documents"), False).where(F.col("source_type").isin("doc", "pdf"))
    return ev.groupBy("path", "symbol").agg(F.round(F.max("confidence") * 0.92, 4).alias("confidence"), F.count("*").alias("mentions"))


@query("grf_14_protected_edges", f"WITH {_WEIGHTED} SELECT src, dst, relation FROM w WHERE stage = 'semantic'")
def _(t):
    return _weighted(t).where("stage = 'semantic'").select("src", "dst", "relation")


@query("grf_20_contract", f"WITH {_EDGES}, n AS (SELECT src node FROM e UNION SELECT dst FROM e) SELECT count(*) AS nodes, count(*) FILTER (WHERE NOT (node LIKE 'register:%' OR node LIKE 'function:%' OR contains(node, '#') OR contains(node, '.'))) AS outside, count(*) FILTER (WHERE node NOT IN (SELECT trim(id) FROM graph_nodes WHERE id IS NOT NULL)) AS unknown FROM n")
def _(t):
    n = G.clean_edges(t("edges")).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = t("graph_nodes").where("id is not null").select(F.trim("id").alias("node")).distinct().withColumn("_k", F.lit(1))
    ok = F.col("node").startswith("register:") | F.col("node").startswith("function:") | F.col("node").contains("#") | F.col("node").contains(".")
    return n.join(known, "node", "left").agg(F.count("*").alias("nodes"), F.sum((~ok).cast("bigint")).alias("outside"), F.sum(F.col("_k").isNull().cast("bigint")).alias("unknown"))


@query("grf_01_neighbour_counts", f"WITH {_EDGES}, b AS (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e) SELECT a AS node, count(*) AS neighbours FROM b GROUP BY 1")
def _(t):
    e = G.clean_edges(t("edges"))
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("b")).union(e.select("dst", "src")).distinct()
    return both.groupBy("node").agg(F.count("*").alias("neighbours"))


@query("frs_04_stale_semantic", f"""WITH {_EDGES}, {_JOBS}, f AS (SELECT max(id) floor FROM j WHERE status = 'succeeded' AND kind IN ('index', 'graph_rebuild')),
q AS (SELECT CASE WHEN json_valid(provenance_json) THEN try_cast(provenance_json ->> '$.job_id' AS BIGINT) END job_id FROM e WHERE stage = 'semantic')
SELECT count(*) AS semantic, count(*) FILTER (WHERE job_id IS NULL) AS without_job, count(*) FILTER (WHERE job_id < floor) AS stale, count(*) FILTER (WHERE job_id NOT IN (SELECT id FROM j)) AS unknown_job FROM q, f""")
def _(t):
    return J.stale_semantic(G.clean_edges(t("edges")), t("jobs"))


@query("frs_02_job_providers", f"WITH {_JOBS} SELECT id, CASE WHEN json_valid(metadata_json) THEN metadata_json ->> '$.provider_settings.edge.provider' END AS provider, CASE WHEN json_valid(metadata_json) THEN metadata_json ->> '$.provider_settings.edge.model' END AS model FROM j")
def _(t):
    return J.clean_jobs(t("jobs")).select("id", "provider", "model")


@query("snk_04_delete_corpus", """WITH gone AS (SELECT DISTINCT id FROM source_documents WHERE corpus_id = 'vexa-mxvirt')
SELECT (SELECT count(DISTINCT id) FROM source_documents WHERE corpus_id IS DISTINCT FROM 'vexa-mxvirt') AS documents, (SELECT count(DISTINCT id) FROM chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)) AS chunks,
(SELECT count(DISTINCT id) FROM edges WHERE coalesce(CASE WHEN json_valid(provenance_json) THEN provenance_json ->> '$.corpus_id' END, '') <> 'vexa-mxvirt') AS edges""")
def _(t):
    d, c, e = without_corpus(t("source_documents"), t("chunks"), t("edges"), ["vexa-mxvirt"])
    one = lambda df, name: df.agg(F.countDistinct("id").alias(name))
    return one(d, "documents").crossJoin(one(c, "chunks")).crossJoin(one(e, "edges"))  # one row each


@query("cli_02_source_facets", f"WITH {_WEIGHTED} SELECT coalesce(source, 'none') AS source, count(*) AS edges FROM (SELECT unnest(CASE WHEN len(sources) = 0 THEN ['none'] ELSE sources END) source FROM w) GROUP BY 1")
def _(t):
    w = _weighted(t).select(F.explode(F.when(F.size("sources") == 0, F.array(F.lit("none"))).otherwise(F.col("sources"))).alias("source"))
    return w.groupBy("source").agg(F.count("*").alias("edges"))


@query("cli_07_display_weights", f"WITH {_WEIGHTED} SELECT src, dst, relation, greatest(0.08, least(1.0, coalesce(weight, confidence, 0.5))) AS weight FROM w")
def _(t):
    return _weighted(t).select("src", "dst", "relation", V.clamp(F.coalesce("weight", "confidence", F.lit(0.5)), 0.08, 1.0).alias("weight"))


@query("cli_11_lifecycles", f"WITH v AS (SELECT DISTINCT id, job_id, {_STATUS.format('status')} status FROM job_events WHERE id IS NOT NULL AND job_id IS NOT NULL) SELECT job_id, string_agg(status, ' -> ' ORDER BY id) AS lifecycle FROM v GROUP BY 1")
def _(t):
    v = t("job_events").where("id is not null and job_id is not null").dropDuplicates(["id"]).select("id", "job_id", V.job_status(F.col("status")).alias("status"))
    return v.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "status"))), lambda x: x["status"]), " -> ").alias("lifecycle"))


@query("ord_03_top_symbols_per_document", f"WITH {_EVIDENCE}, k AS (SELECT document_id, symbol, count(*) AS chunks FROM ev GROUP BY 1, 2) SELECT document_id, symbol, chunks, row_number() OVER (PARTITION BY document_id ORDER BY chunks DESC, symbol) AS place FROM k QUALIFY place <= 5")
def _(t):
    k = E.chunk_symbols(E.chunk_rows(t("chunks"), t("source_documents")).select("id", "document_id", "text", "source_type")).groupBy("document_id", "symbol").agg(F.count("*").alias("chunks"))
    place = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("chunks"), "symbol"))
    return k.withColumn("place", place).where("place <= 5")


@query("sem_01_candidates")
def _(t):
    return semantic.candidates(E.evidence(t("chunks"), t("source_documents")))


@query("sem_04_persistable", f"WITH {_EDGES}, n AS (SELECT DISTINCT trim(id) id FROM graph_nodes WHERE id IS NOT NULL) SELECT src, relation, dst, max(confidence) AS confidence FROM e WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1, 2, 3")
def _(t):
    return semantic.persistable(G.clean_edges(t("edges")), t("graph_nodes").where("id is not null").select(F.trim("id").alias("id")))


@query("ext_12_term_edges", f"""WITH {_CHUNKS}, k AS (SELECT document_id, id, symbol, row_number() OVER (PARTITION BY id ORDER BY symbol) p FROM s JOIN c USING (id) WHERE regexp_matches(symbol, '^(mm|reg|smn)[A-Z]'))
SELECT a.symbol AS src, b.symbol AS dst, count(*) AS chunks FROM k a JOIN k b ON a.id = b.id AND b.p = a.p + 1 GROUP BY 1, 2""")
def _(t):
    s = E.chunk_symbols(E.chunk_rows(t("chunks"), t("source_documents"))).where(F.col("symbol").rlike("^(?:mm|reg|smn)[A-Z]")).select("id", "symbol")
    nxt = F.lead("symbol").over(W.partitionBy("id").orderBy("symbol"))
    return s.withColumn("dst", nxt).where("dst is not null").groupBy(F.col("symbol").alias("src"), "dst").agg(F.count("*").alias("chunks"))


@query("ret_16_reciprocal_rank")
def _(t):
    k = E.evidence(t("chunks"), t("source_documents")).where("access_type = 'write'")
    ranked = written(R.query_evidence(k, t("chunks"), "who writes the SDMA ring registers", None).select("rank_score", "symbol", "chunk_id"), "ranked")
    first = R.best_rank(ranked, F.col("symbol").contains("STATUS"))
    return R.reciprocal_rank(first, first.select("case_id", "key"))


@query("grf_11_enclosing_functions", f"""WITH {_EDGES}, f AS (SELECT DISTINCT path, line_start first_line, name FROM function_locations WHERE path IS NOT NULL AND line_start IS NOT NULL AND name IS NOT NULL)
SELECT e.id, arg_max(f.name, (f.first_line, f.name)) AS function FROM e JOIN f ON f.path = e.path AND f.first_line <= e.line_start AND f.first_line >= e.line_start - 800 GROUP BY 1""")
def _(t):
    return G.enclosing_functions(G.clean_edges(t("edges")), t("function_locations"))


@query("jon_08_corpus_chunks", "SELECT corpus_id, count(DISTINCT c.id) AS chunks FROM chunks c JOIN (SELECT DISTINCT id, corpus_id FROM source_documents) d ON d.id = c.document_id GROUP BY 1")
def _(t):
    d = t("source_documents").select(F.col("id").alias("document_id"), "corpus_id").distinct()
    return t("chunks").join(d, "document_id").groupBy("corpus_id").agg(F.countDistinct("id").alias("chunks"))


@query("ret_06_candidate_cascade")
def _(t):
    e = written(E.evidence(t("chunks"), t("source_documents"), False), "evidence")
    return R.candidate_cascade(e, R.phrase_match(t("chunks"), _TOKENS), _TOKENS, 5760)


FLAGSHIP = "ret_15_query_evidence"
