"""Core queries leave no rows out: results on rows that their SQL does not take."""

import pytest
from lodeweave import queries
from oracle import connect, rows


@pytest.mark.parametrize("name", ["scl_09_headings", "scl_10_section_ids"])
def test_chunks_with_carriage_returns(spark, small, name):
    """The SQL leaves such chunks out; over the same chunks with plain line ends it gives all rows."""
    con = connect(small)
    con.execute(f"CREATE OR REPLACE VIEW chunks AS SELECT * REPLACE (replace(text, chr(13), '') AS text) FROM '{small}/chunks.parquet'")
    assert rows(queries.QUERIES[name](spark, small).toPandas()) == rows(con.execute(queries.ORACLE[name]).df())


def test_heading_ends_before_a_carriage_return(spark):
    from lodeweave.functions import vocab as V
    from pyspark.sql import functions as F

    texts = ["1: x\r\n2: ## A title\r\n3: y\r", "# B\r", "x\r# C\rz", "x\r\ny"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.h for r in df.orderBy("i").select(V.heading(F.col("text")).alias("h")).collect()] == ["A title", "B", "C", ""]


CHUNK = "id bigint, document_id bigint, text string, line_start int, page int"
DOCUMENT = "id bigint, path string, repo string, corpus_id string, indexed_at timestamp"


def evidence_of(spark, texts):
    """Evidence of (path, text, page), each a document of one chunk; ids from 1."""
    from datetime import datetime

    from lodeweave.operators import evidence as E

    chunks = spark.createDataFrame([(i, i, t, 1, page) for i, (_, t, page) in enumerate(texts, 1)], CHUNK)
    docs = spark.createDataFrame([(i, p, "r", "c", datetime(2024, 1, 1)) for i, (p, _, _) in enumerate(texts, 1)], DOCUMENT)
    return E.evidence(chunks, docs)


def test_documents_without_symbols_have_an_anchor(spark):
    texts = [("a/plain.md", "1: Only words,\n2: as plain.md says.", None), ("b/my_book.pdf", "words", 3), ("b/x.pdf", "words", None), ("b/y.rst", " \n", None), ("c/z.c", "int words;", None), ("a/w.md", "has a_symbol", None), ("a/RING_STATUS.txt", "words", None)]
    got = {(r.chunk_id, r.symbol): (r.entity_type, r.access_type, r.confidence, r.snippet, r.resolved_chain) for r in evidence_of(spark, texts).collect()}
    assert got.pop((6, "a_symbol"))[1] == "mention"
    assert got == {
        (1, "plain.md"): ("doc_section", "mention", 0.95, texts[0][1], "doc chunk -> plain.md"),
        (2, "my_book.pdf#page=3"): ("function", "mention", 0.75, "words", "pdf chunk -> my_book.pdf#page=3"),
        (3, "x.pdf#page=1"): ("pdf_page", "mention", 0.75, "words", "pdf chunk -> x.pdf#page=1"),
        (7, "RING_STATUS.txt"): ("register", "mention", 0.75, "words", "doc chunk -> RING_STATUS.txt"),
    }


def test_evidence_is_that_of_the_sql_with_one_anchor_for_each_chunk_without(spark, small):
    con = connect(small)
    ours, theirs = rows(queries.QUERIES["ext_04_evidence"](spark, small).toPandas()), rows(con.execute(queries.ORACLE["ext_04_evidence"]).df())
    bare = f"WITH {queries._CHUNKS} SELECT id FROM r WHERE source_type IN ('doc', 'pdf') AND regexp_matches(text, '\\S') AND id NOT IN (SELECT id FROM s)"
    assert ours == theirs and len(ours) == len(set(ours))
    without = sorted(str(i) for (i,) in con.execute(bare).fetchall())
    assert sorted(r[1] for r in ours if r[1] in without) == without != []


def test_candidates_keep_single_terms_all_terms_and_all_snippets(spark):
    from lodeweave.operators import semantic

    many = "\n".join(f"reg_{i:02}" + "x" * 600 for i in range(30))
    got = {r.chunk_id: r for r in semantic.candidates(evidence_of(spark, [("a.c", "only_one here", None), ("b.c", many, None), ("c.c", "none", None)])).collect()}
    assert set(got) == {1, 2} and (got[1].terms, got[1].snippets) == (["only_one"], ["only_one here"])
    terms = many.split("\n")
    assert got[2].terms == terms
    assert got[2].snippets == [t[:500] for t in terms[:1] * 3 + terms[1:-2]][2:]


def test_cooccurrence_has_all_pairs_of_a_chunk(spark):
    from itertools import combinations

    from lodeweave.operators import evidence as E

    names = [f"s_{i:02}" for i in range(12)]
    got = {(r.src, r.dst): (r.chunks, r.confidence) for r in E.cooccurrence(evidence_of(spark, [("a.c", " ".join(names), None), ("b.c", "s_00 s_11", None)])).collect()}
    assert got == {p: (2 if p == ("s_00", "s_11") else 1, 0.95) for p in combinations(names, 2)}
