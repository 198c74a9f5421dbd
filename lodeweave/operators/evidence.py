"""Chunks of documents and the evidence rows of chunks, as projections without Python.

Null texts give no rows, repeated rows count once where a result is per chunk and symbol, extra
columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import symbols as S
from ..functions import vocab as V


def chunk_lines(documents: DataFrame, key: str, text: str, size: int = 40) -> DataFrame:
    """(key, chunk, line_start, line_end, text): runs of ``size`` lines, each line stored as `N: ` + line.

    Lines are cut by array functions inside a row, so nothing is shuffled.
    """
    lines = F.split(F.col(text), "\n")
    numbered = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    cut = documents.where(F.col(text).isNotNull()).select(F.col(key), numbered.alias("_l"))
    parts = cut.select(key, "_l", F.explode(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / size).cast("int"))).alias("chunk"))
    start = F.col("chunk") * size + 1
    return parts.select(key, "chunk", start.alias("line_start"), F.least(start + size - 1, F.size("_l")).alias("line_end"), F.array_join(F.slice("_l", start, F.lit(size)), "\n").alias("text"))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({S.IDENTIFIER})"), 1)


def chunk_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Each chunk once with path, repo and source type of its document (its latest row)."""
    latest = (
        documents.where("id is not null")
        .groupBy(F.col("id").alias("document_id"))
        .agg(F.max_by("path", F.struct("indexed_at", "path")).alias("path"), F.max_by("repo", F.struct("indexed_at", "path")).alias("repo"), F.max_by("corpus_id", F.struct("indexed_at", "path")).alias("corpus_id"))
    )
    once = chunks.where("id is not null and text is not null").select("id", "document_id", "text", "line_start", "page").dropDuplicates(["id"])
    return once.join(latest, "document_id").withColumn("source_type", V.source_type(F.col("path"))).withColumn("repo", V.repository(F.col("repo")))


def chunk_symbols(rows: DataFrame) -> DataFrame:
    """(chunk row, symbol): distinct symbols of each chunk; register headers have rules of their own."""
    each = rows.withColumn("symbol", F.explode(F.array_distinct(identifiers(F.col("text")))))
    return each.where(_counts())


def _counts() -> Column:
    return F.when(F.col("source_type") == "register", S.is_header_symbol(F.col("symbol"))).otherwise(S.is_symbol(F.col("symbol")))


def document_anchor() -> Column:
    """`name.pdf#page=N` or the file name, for a non-blank doc or pdf chunk without any symbol; null for other chunks."""
    name = F.element_at(F.split("path", "/"), -1)
    page = F.when(F.col("page") != 0, F.col("page")).otherwise(1).cast("string")
    bare = F.col("source_type").isin("doc", "pdf") & F.col("text").rlike(r"\S") & ~F.exists(identifiers(F.col("text")), S.is_symbol)
    return F.when(bare, F.when(F.col("source_type") == "pdf", F.concat(name, F.lit("#page="), page)).otherwise(name))


def _arguments(prefix: str) -> Column:
    """What the text passes to wrappers of a prefix, up to the first closing parenthesis of each call."""
    return F.regexp_extract_all(F.col("text"), F.lit(rf"\b{prefix}[0-9A-Z_]*\s*\(([^)]*)"), 1)


def evidence(chunks: DataFrame, documents: DataFrame, with_snippet: bool = True) -> DataFrame:
    """Evidence rows, one per chunk and symbol; a doc or pdf chunk without symbols has one row for its anchor.

    The call arguments and words of a chunk are extracted once, before the symbols are exploded, so
    no pattern is built per symbol.
    """
    rows = chunk_rows(chunks, documents).withColumns({"_w": _arguments("WREG"), "_r": _arguments("RREG"), "_words": F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), 1)), "_set": F.col("text").contains("REG_SET_FIELD"), "_anchor": document_anchor()})
    sym, anchor = F.col("symbol"), F.col("_anchor").isNotNull()
    each = rows.withColumn("symbol", F.explode(F.when(anchor, F.array("_anchor")).otherwise(F.array_distinct(identifiers(F.col("text")))))).where(anchor | _counts())
    access = (
        F.when(anchor, "mention")
        .when(F.col("_set"), F.when(S.entity_type(sym) == "field", "field_set").otherwise("read_modify_write"))
        .when(F.exists("_w", lambda a: a.contains(sym)), "write")
        .when(F.exists("_r", lambda a: a.contains(sym)), "read")
        .otherwise("mention")
    )
    header = F.when(sym.rlike(V.FIELD_NAME), "field").when(sym.rlike("^(?:WREG|RREG|REG_)"), "macro").when(S.is_header_symbol(sym), "register").otherwise(S.entity_type(sym))
    first = F.element_at(F.split(sym, "->"), 1)
    last = F.element_at(F.split(sym, "->"), -1)
    whole = F.array_contains("_words", first) & F.array_contains("_words", last)
    part = F.when(S.is_symbol(sym), S.entity_type(sym)).when(F.col("source_type") == "pdf", "pdf_page").otherwise("doc_section")
    named = F.when(anchor, F.regexp_like("text", F.concat(F.lit(r"\b\Q"), "_anchor", F.lit(r"\E\b")))).otherwise(whole)
    out = each.withColumn("entity_type", F.when(anchor, part).when(F.col("source_type") == "register", header).otherwise(S.entity_type(sym))).withColumn("access_type", access)
    out = out.withColumn("confidence", F.when(named, 0.95).otherwise(0.75)).withColumn("ip_block", V.ip_block(sym, F.col("path")))
    cols = [F.col("id").alias("chunk_id"), "document_id", "corpus_id", "repo", "path", "source_type", "page", "line_start", "symbol", "entity_type", "access_type", "confidence", "ip_block"]
    if with_snippet:
        cols += [S.snippet(F.col("text"), sym).alias("snippet"), F.when(anchor, F.concat("source_type", F.lit(" chunk -> "), sym)).otherwise(S.resolved_chain(F.col("text"), sym, F.col("access_type"))).alias("resolved_chain")]
    return out.select(*cols)


def cooccurrence(rows: DataFrame) -> DataFrame:
    """(src, dst, chunks, confidence): all pairs of the symbols of each chunk, as in the reference's storage without its optional limit.

    The workbench's limits file sets cooccurrenceSymbolLimit to 8 for its display; no limit is taken here.
    """
    packed = rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("symbol", "confidence"))).alias("_s"))
    pairs = packed.select(F.posexplode("_s").alias("_i", "a"), "_s").select("a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("b"))
    return pairs.groupBy(F.col("a.symbol").alias("src"), F.col("b.symbol").alias("dst")).agg(F.count("*").alias("chunks"), F.round(F.avg((F.col("a.confidence") + F.col("b.confidence")) / 2), 4).alias("confidence"))


def doc_candidates(rows: DataFrame) -> DataFrame:
    """Evidence, register and function counts per chunk of documents."""
    docs = rows.where(F.col("source_type").isin("doc", "pdf"))
    return docs.groupBy("chunk_id").agg(F.count("*").alias("evidence"), F.sum((F.col("entity_type") == "register").cast("bigint")).alias("registers"), F.sum((F.col("entity_type") == "function").cast("bigint")).alias("functions"))
