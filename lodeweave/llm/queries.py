"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from . import codefiles, docpairs, leakage, neardup, ocr, packing, splitting, subjects


def _with(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(lambda name: table(spark, sf_dir, name))

    return run


def _pairs(t) -> DataFrame:
    functions = codefiles.file_functions(t("chunks"), t("source_documents"), hierarchy=True)
    repos = t("source_documents").where("id is not null").groupBy(F.col("id").alias("document_id")).agg(codefiles.repository(F.max("repo")).alias("repo"))
    pairs = docpairs.inherit_documentation(functions.join(repos, "document_id"))
    return pairs.select("document_id", "repo", "path", "language", "name", "line_start", "line_end", "class_name", "description", "code", "doc_origin")


QUERIES = {
    "p1_found": _with(lambda t: ocr.noise_cases(t("document_chunks"))),
    "p1_paragraphs": _with(lambda t: ocr.repaired(t("document_chunks"))),
    "p2_found": _with(lambda t: splitting.split_oversized(t("chunks")).where("pieces > 1").select("id").distinct()),
    "p2_pieces": _with(lambda t: splitting.split_oversized(t("chunks"))),
    "p4_found": _with(lambda t: codefiles.file_functions(t("chunks"), t("source_documents"), False).where("description is not null").select("document_id", "name", "line_start").distinct()),
    "p4_pairs": _with(_pairs),
    "p5_found": _with(lambda t: codefiles.parse_files(t("chunks"), t("source_documents")).where("not valid").select("document_id").distinct()),
    "p5_files": _with(lambda t: codefiles.parse_files(t("chunks"), t("source_documents"))),
    "p5_rates": _with(lambda t: codefiles.parse_rates(codefiles.parse_files(t("chunks"), t("source_documents")), t("source_documents"))),
    "p6_found": _with(lambda t: neardup.near_duplicate_pairs(t("chunks"), 0.6)),
    "p6_groups": _with(lambda t: neardup.near_duplicate_groups(t("chunks"), 0.6)),
    "p7_containers": _with(lambda t: packing.packed(t("documents"))),
    "p7_summary": _with(lambda t: packing.packing_summary(packing.packed(t("documents")))),
    "p8_found": _with(lambda t: leakage.leaked(t("documents"), t("eval_items"))),
    "p8_regions": _with(lambda t: leakage.leaked_regions(t("documents"), t("eval_items"))),
    "p9_found": _with(lambda t: subjects.assigned(t("documents"), t("subject_labels")).select("doc_id", "subject").distinct()),
    "p9_composition": _with(lambda t: subjects.composition(subjects.assigned(t("documents"), t("subject_labels")))),
}

#: What plain SQL can say on whole tables.
ORACLE = {
    "p2_found": "SELECT DISTINCT id FROM chunks WHERE length(text) > 6000",
    "p8_found": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') w FROM eval_items WHERE text IS NOT NULL),
ir AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) i FROM iw)),
dr AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM dw))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)""",
    "p6_found": r"""
WITH w AS (SELECT id, regexp_extract_all(lower(regexp_replace(text, '(^|\n)\d+: ?', '\1', 'g')), '[a-z0-9_]+') w FROM (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL)),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) i FROM w WHERE len(w) >= 40)),
n AS (SELECT id, count(*) n FROM s GROUP BY id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.id, s.g FROM s JOIN f USING (g)),
p AS (SELECT a.id id_a, b.id id_b, count(*) c FROM r a JOIN r b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)""",
}
