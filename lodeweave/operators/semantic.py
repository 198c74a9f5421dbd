"""Around generated edges and embeddings: candidates, persistence filters, grounding, backfill with an injected provider.

Null or blank ends, self loops and repeated (src, relation, dst) drop out; empty tables give empty
results; extra columns of inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V


def candidates(evidence: DataFrame, snippet: int = 500) -> DataFrame:
    """(chunk_id, path, terms, snippets): every chunk with a term; all terms and the distinct snippets, each cut to ``snippet`` characters, in order of confidence."""
    g = evidence.groupBy("chunk_id", "path").agg(F.array_sort(F.collect_set(F.struct((-F.col("confidence")).alias("c"), "symbol", F.substring(F.trim("snippet"), 1, snippet).alias("snippet")))).alias("_t"))
    terms, snippets = F.array_distinct(F.transform("_t", lambda x: x["symbol"])), F.array_distinct(F.transform("_t", lambda x: x["snippet"]))
    return g.select("chunk_id", "path", terms.alias("terms"), F.filter(snippets, lambda x: x != "").alias("snippets"))


def persistable(generated: DataFrame, allowed: DataFrame) -> DataFrame:
    """Generated edges that may be stored: normalised relation, both ends allowed and different, each edge once."""
    e = generated.select(F.trim("src").alias("src"), F.trim("dst").alias("dst"), V.relation(F.col("relation")).alias("relation"), "confidence")
    e = e.where("src <> '' and dst <> '' and src <> dst and relation is not null")
    ok = allowed.select(F.col(allowed.columns[0]).alias("_n")).distinct()
    e = e.join(ok, F.col("src") == F.col("_n"), "left_semi").join(ok, F.col("dst") == F.col("_n"), "left_semi")
    return e.groupBy("src", "relation", "dst").agg(F.max("confidence").alias("confidence"))


def grounded(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds grounded: whether both labels occur in the text of the edge's source chunk (chunk_id, text)."""
    label = lambda c: F.lower(F.substring_index(c, ":", -1))
    text = F.lower(F.coalesce("text", F.lit("")))
    return edges.join(sources.select("chunk_id", "text"), "chunk_id", "left").withColumn("grounded", text.contains(label(F.col("src"))) & text.contains(label(F.col("dst")))).drop("text")


def backfill(chunks: DataFrame, have: DataFrame, embed: Callable[[list[str]], list[list[float]]], most_chars: int = 8000) -> DataFrame:
    """(id, vector) of chunks without one; equal texts are embedded once; a text that the provider refuses is halved until it takes it."""
    missing = chunks.where("id is not null and text is not null").select("id", F.substring("text", 1, most_chars).alias("text")).dropDuplicates(["id"]).join(have.select("id"), "id", "left_anti")
    texts = missing.select("text").distinct()

    def one(batch: list[str]) -> list[list[float]]:
        try:
            return embed(batch)
        except ValueError:
            if len(batch) > 1:
                mid = len(batch) // 2
                return one(batch[:mid]) + one(batch[mid:])
            if len(batch[0]) < 2:
                raise
            return one([batch[0][: len(batch[0]) // 2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0).to_pylist()
            if t:
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(one(t), pa.list_(pa.float64()))], names=["text", "vector"])

    return missing.join(texts.mapInArrow(run, "text string, vector array<double>"), "text").select("id", "vector")
