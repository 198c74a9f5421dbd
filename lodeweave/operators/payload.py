"""Graph payloads: k-hop subgraphs with projected ends, query graphs, folded fields, and the filters of a client.

Edges are those of ``graph.clean_edges`` (trimmed ends, normalised relations).  Null ends and
relations are left out, repeated edges merge, seeds without edges stay as nodes; ties are broken by
(src, relation, dst).  Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions.symbols import is_wrapper
from . import graph as G


def unwrapped(edges: DataFrame) -> DataFrame:
    """Edges without resolver wrappers at an end; isolated nodes never exist in this graph."""
    return edges.where(~is_wrapper(G.label(F.col("src"))) & ~is_wrapper(G.label(F.col("dst"))))


def has_edges(edges: DataFrame) -> bool:
    return not edges.limit(1).isEmpty()


def under_cap(rows: DataFrame, cap: int) -> bool:
    """Whether a table has at most ``cap`` rows; no more than cap + 1 are counted."""
    return rows.limit(cap + 1).count() <= cap


def legacy_hops(edges: DataFrame, seed: str, hops: int) -> DataFrame:
    """(src, dst, relation, confidence): edges that a frontier search from one symbol touches; of repeated ones the least confident, which comes last in its order."""
    clean = unwrapped(edges)
    seeds = edges.sparkSession.createDataFrame([(seed,)], "node string")
    seeds = seeds.where(~is_wrapper(F.col("node")))
    reached = G.expand(clean, seeds, hops)
    inner = reached.where(F.col("hop") < max(1, hops)).select("node")
    out = clean.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "relation", "confidence")
    back = clean.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "relation", "confidence")
    return out.unionByName(back).groupBy("src", "dst", "relation").agg(F.min("confidence").alias("confidence"))


def folded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, fields): `sets_field` edges between a register and a field become an attribute of the register.

    fields (register, fields) holds one row per register; a hot register's fields are made distinct
    before they are collected.
    """
    kind = lambda c: F.when(c.startswith("register:"), "register").when(c.startswith("field:"), "field")
    a, b = kind(F.col("src")), kind(F.col("dst"))
    fold = F.coalesce((F.col("relation") == "sets_field") & (((a == "register") & (b == "field")) | ((a == "field") & (b == "register"))), F.lit(False))
    own = edges.where(fold).select(F.when(a == "register", F.col("src")).otherwise(F.col("dst")).alias("register"), F.when(a == "register", F.col("dst")).otherwise(F.col("src")).alias("field")).distinct()
    return edges.where(~fold), own.groupBy("register").agg(F.sort_array(F.collect_list("field")).alias("fields"))


def subgraph(weighted: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a k-hop neighbourhood.

    Edges come merged with a rank by (-confidence, src, dst, relation); a node's weight is 1 and one
    more per further edge it occurs in; seeds without edges are nodes of weight 1.
    """
    reached = G.expand(weighted, seeds, hops)
    edges = G.touched_edges(weighted, reached, hops)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").cast("double").alias("weight"))
    alone = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().join(ends, "node", "left_anti").withColumn("weight", F.lit(1.0))
    nodes = ends.unionByName(alone).select("node", G.node_kind(F.col("node")).alias("kind"), G.label(F.col("node")).alias("label"), F.round("weight", 4).alias("weight"))
    return nodes, edges


def query_graph(weighted: DataFrame, ranked: DataFrame, hops: int, seeds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the first ``seeds`` distinct symbols of ranked rows (symbol, rank_score); a node is a symbol's if its label is.

    Edges are keyed by (src, relation, dst) without the stage, the first by weight counts.
    """
    first = ranked.groupBy("symbol").agg(F.max("rank_score").alias("_s")).orderBy(F.desc("_s"), "symbol").limit(seeds).select("symbol")
    ends = weighted.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = ends.join(F.broadcast(first), F.expr("element_at(split(node, ':'), -1) = symbol"), "left_semi")  # at most `seeds` rows
    nodes, edges = subgraph(weighted, found, hops)
    order = W.partitionBy("src", "relation", "dst").orderBy(F.desc("weight"), F.desc("confidence"))
    return nodes, edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def selected(nodes: DataFrame, edges: DataFrame, relations: list[str] | None = None, stages: list[str] | None = None, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A client's multiple choice: edges by relation, stage and source (an empty choice matches all), and their nodes; all nodes where there are no edges at all."""
    keep = F.lit(True)
    if relations:
        keep = keep & F.col("relation").isin(relations)
    if stages:
        keep = keep & F.col("stage").isin(stages)
    if sources:
        keep = keep & F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources]))
    left = edges.where(keep)
    if not has_edges(edges):
        return nodes, left
    ends = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(ends, "node", "left_semi"), left


def visible(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int, least_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """A client's budget: the heaviest nodes, then the first edges with both ends among them. The limits are the operator's feature."""
    some = nodes.orderBy(F.desc("weight"), "node").limit(most_nodes)
    inside = G.induced_edges(edges.where(F.col("weight") >= least_weight), some)
    return some, inside.orderBy(F.desc("weight"), "src", "relation", "dst").limit(most_edges)


def sanitised(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the allowed kinds, and edges that don't dangle."""
    kept = nodes.where(F.col("kind").isin(kinds))
    return kept, G.induced_edges(edges, kept)


def product_edges(edges: DataFrame, words: list[str]) -> DataFrame:
    """Edges between two different endpoints of product kinds, with both kinds."""
    e = edges.withColumns({"src_kind": C.endpoint_kind(F.col("src"), words), "dst_kind": C.endpoint_kind(F.col("dst"), words)})
    return e.where("src_kind is not null and dst_kind is not null and src <> dst")


def merged_nodes(parts: DataFrame) -> DataFrame:
    """Node payloads (node, kind, weight, ins, outs) of several graphs as one: largest weight, at least 1, first kind by name, lines of both joined."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return parts.groupBy("node").agg(F.min("kind").alias("kind"), F.greatest(F.lit(1.0), F.max("weight")).alias("weight"), union("ins").alias("ins"), union("outs").alias("outs"))


def provenance_label(edges: DataFrame) -> DataFrame:
    """Edges with a label: provider and model, job, source where it is another than the provider, dispatch with its candidates."""
    p = lambda n: C.json_field(F.col("provenance_json"), n)
    scope = F.when(p("dispatch_scope") == "ambiguous", "dynamic dispatch").otherwise(p("dispatch_scope"))
    source = F.when(F.trim("source") != "", F.trim("source"))
    return edges.withColumn(
        "provenance",
        F.concat_ws(" ", F.concat_ws("/", p("provider"), p("model")), F.concat(F.lit("job "), p("job_id")), F.when(p("provider").isNull() | (source != p("provider")), source), scope, F.concat(F.lit("("), p("candidate_count"), F.lit(" candidates)"))),
    )
