"""Edge projection, weighted aggregation, neighbourhoods, components and budgeted selection.

Edges with a null or blank end drop out; ends are trimmed; repeated rows count once by id; null
confidences count as one half; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..session import written
from .components import connected_components

OPERATIONS = ["reads", "writes", "sets_field", "maps_base"]


def clean_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, ends trimmed, relation normalised; rows whose relation only tells provenance drop out."""
    rows = edges.select("id", F.trim("src").alias("src"), F.trim("dst").alias("dst"), V.relation(F.col("relation")).alias("relation"), "confidence", "stage", "source", "path", "line_start", "line_end", "provenance_json", "ingested_at")
    return rows.where("src <> '' and dst <> '' and relation is not null").dropDuplicates(["id"])


def node_kind(node: Column) -> Column:
    """Kind by the id's first part."""
    return F.when(node.startswith("register:"), "register").when(node.startswith("function:"), "function").otherwise("doc")


def label(node: Column) -> Column:
    return F.substring_index(node, ":", -1)


def function_scope(node: Column) -> Column:
    return F.when(node.startswith("function:"), F.element_at(F.split(node, ":"), 2)).otherwise("")


def weighted(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, relation): mean confidence, weight with a boost for repetition, count, stage, sources.

    One shuffle with partial aggregation; a hot node's edges combine before it.
    """
    c = V.edge_confidence(F.col("confidence"))
    g = edges.groupBy("src", "dst", "relation").agg(
        F.count("*").alias("count"), F.avg(F.round(c, 6)).alias("_avg"), F.min("stage").alias("_s0"), F.max("stage").alias("_s1"), F.sort_array(F.collect_set(F.when(F.trim("source") != "", F.trim("source")))).alias("sources")
    )
    boost = F.when(F.col("count") > 1, F.least(F.lit(0.35), F.log1p(F.col("count").cast("double")) / 12)).otherwise(0.0)
    return g.select(
        "src", "dst", "relation", "count", F.round(F.least(F.lit(1.0), F.col("_avg")), 4).alias("confidence"), F.round(F.least(F.lit(1.0), F.col("_avg") + boost), 4).alias("weight"),
        F.when(F.col("_s0") == F.col("_s1"), F.col("_s0")).otherwise("mixed").alias("stage"), "sources",
    )


def node_weights(edges: DataFrame) -> DataFrame:
    """(node, kind, weight, edges): sum of the weights of incident edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.round(F.sum(F.col("weight").cast("decimal(20,4)")), 4).cast("double").alias("weight"), F.count("*").alias("edges")).withColumn("kind", node_kind(F.col("node")))


def ordered(edges: DataFrame) -> list[Column]:
    return [V.relation_priority(F.col("relation")), F.desc("weight"), F.desc("count"), F.desc("confidence"), F.col("src"), F.col("dst"), F.col("relation")]


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` (cut to 1..10) of the seeds, edges taken both ways.

    The frontier joins the edges, not the other way round; what was seen drops out by an anti join.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    seen = written(seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("hop")).distinct(), "seen")
    frontier = seen
    for hop in range(1, max(1, min(10, hops)) + 1):
        reached = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def touched_edges(edges: DataFrame, reached: DataFrame, hops: int) -> DataFrame:
    """Edges that a frontier of fewer than ``hops`` hops touches."""
    inner = reached.where(F.col("hop") < hops).select("node")
    out = edges.join(inner.select(F.col("node").alias("src")), "src", "left_semi").select(edges.columns)
    back = edges.join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select(edges.columns)
    return out.unionByName(back).dropDuplicates(["src", "dst", "relation"])


def induced_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges with both ends among the reached nodes."""
    n = reached.select("node").distinct()
    return edges.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi").select(edges.columns)


def bridges(edges: DataFrame) -> DataFrame:
    """Registers used from more than one function scope: (register, scope, best edge), best edge per scope."""
    ops = edges.where(F.col("relation").isin(OPERATIONS) & F.col("src").startswith("function:") & F.col("dst").startswith("register:"))
    scoped = ops.withColumn("scope", function_scope(F.col("src")))
    shared = scoped.groupBy("dst").agg(F.countDistinct("scope").alias("scopes"), F.sum("count").alias("uses")).where("scopes > 1")
    order = W.partitionBy("dst", "scope").orderBy(F.desc("weight"), F.desc("count"), "src", "relation")
    best = scoped.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return best.join(shared, "dst").select(F.col("dst").alias("register"), "scope", "src", "relation", "weight", "scopes", "uses")


def call_components(edges: DataFrame) -> DataFrame:
    """(node, component, size, rank): components of the calls relation, ranked by size and smallest member."""
    parts = connected_components(edges.where("relation = 'calls'"), "src", "dst")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    ranked = sizes.orderBy(F.desc("size"), "component").withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "component")))
    return parts.join(ranked, "component").select("node", "component", "size", "rank")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges of the spanning forest of ``calls`` that comes first by (-weight, -count, src, dst): Boruvka rounds over a total order, each of which at least halves the trees left to join."""
    calls = edges.where("relation = 'calls' and src <> dst")
    key = F.struct((-F.col("weight")).alias("w"), (-F.col("count")).alias("c"), F.col("src").alias("s"), F.col("dst").alias("d"))
    live = written(calls.select(F.col("src").alias("a"), F.col("dst").alias("b"), key.alias("k")), "forest")
    forest = None
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("v"), "k", "a", "b").unionByName(live.select(F.col("b").alias("v"), "k", "a", "b"))
        best = written(ends.groupBy("v").agg(F.min_by(F.struct("a", "b", "k"), "k").alias("e")).select("e.*").distinct(), "picked")
        picked = best.select(F.col("k.s").alias("src"), F.col("k.d").alias("dst"))
        forest = picked if forest is None else forest.unionByName(picked)
        parts = connected_components(best, "a", "b")
        left = live.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        left = left.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "k").where("a <> b")
        live = written(left.groupBy("a", "b").agg(F.min("k").alias("k")), "forest")
    if forest is None:
        return edges.limit(0)
    return edges.where("relation = 'calls'").join(forest.distinct(), ["src", "dst"], "left_semi").select(edges.columns)


def backbone(edges: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` forest edges by component rank, then by weight; other calls fill what is left. The budget is the operator's feature."""
    forest = spanning_forest(edges)
    ranks = call_components(edges).select(F.col("node").alias("src"), "rank")
    fill = edges.where("relation = 'calls'").join(forest.select("src", "dst"), ["src", "dst"], "left_anti")
    both = forest.withColumn("_t", F.lit(0)).unionByName(fill.select(forest.columns).withColumn("_t", F.lit(1)))
    return both.join(ranks, "src", "left").orderBy("_t", "rank", F.desc("weight"), F.desc("count"), "src", "dst").limit(budget).drop("_t")


def budgeted(edges: DataFrame, budget: int) -> DataFrame:
    """Selection under an edge budget: protected edges, shared-register bridges, call backbone, operations next to it, the rest by order."""
    edges = written(edges, "weighted")
    protected = edges.where("stage = 'semantic' or relation in ('contains_box', 'section_mentions')")
    p = min(protected.count(), budget)
    b = budget - p
    parts = [protected.withColumn("_tier", F.lit(0)).withColumn("_o", F.row_number().over(W.orderBy(*ordered(edges))))]
    if b > 1:
        room = min(max(2, b // 10), b)
        shared = bridges(edges).orderBy(F.desc("scopes"), F.desc("uses"), "register", "scope").limit(room)
        keys = shared.select("src", F.col("register").alias("dst"), "relation")
        chosen = written(edges.join(keys, ["src", "dst", "relation"], "left_semi").select(edges.columns), "bridges")
        parts.append(chosen.withColumn("_tier", F.lit(1)).withColumn("_o", F.row_number().over(W.orderBy(*ordered(edges)))))
        b -= chosen.count()
    if b > 0:
        calls = written(backbone(edges, max(1, b - b // 5)).select(edges.columns), "backbone")
        parts.append(calls.withColumn("_tier", F.lit(2)).withColumn("_o", F.row_number().over(W.orderBy(*ordered(edges)))))
        nodes = calls.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        near = edges.where(F.col("relation").isin(OPERATIONS))
        near = near.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select(edges.columns).unionByName(near.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(edges.columns)).dropDuplicates(["src", "dst", "relation"])
        near = near.orderBy(*ordered(edges)).limit(max(0, b - calls.count()))
        parts.append(near.withColumn("_tier", F.lit(3)).withColumn("_o", F.row_number().over(W.orderBy(*ordered(edges)))))
    rest = edges.orderBy(*ordered(edges)).limit(budget)
    parts.append(rest.withColumn("_tier", F.lit(4)).withColumn("_o", F.row_number().over(W.orderBy(*ordered(edges)))))
    everything = parts[0]
    for x in parts[1:]:
        everything = everything.unionByName(x)
    once = everything.withColumn("_n", F.row_number().over(W.partitionBy("src", "dst", "relation").orderBy("_tier", "_o"))).where("_n = 1").drop("_n")
    return once.orderBy("_tier", "_o").limit(budget).drop("_tier", "_o")


def concept_overlap(edges: DataFrame) -> DataFrame:
    """(concept, implementations, overlap, merge_status): smallest pairwise Jaccard index of the register sets of a concept's functions.

    A concept is a function name without its version prefix; its implementations are its functions.
    """
    use = edges.where(F.col("relation").isin(OPERATIONS) & F.col("src").startswith("function:") & F.col("dst").startswith("register:"))
    sets = use.groupBy("src").agg(F.collect_set("dst").alias("registers")).withColumn("concept", F.regexp_replace(label(F.col("src")), "_[0-9a-z]{2}$", ""))
    pairs = sets.alias("x").join(sets.alias("y"), (F.col("x.concept") == F.col("y.concept")) & (F.col("x.src") < F.col("y.src")))
    shared = F.size(F.array_intersect("x.registers", "y.registers")) / F.size(F.array_union("x.registers", "y.registers"))
    low = pairs.groupBy(F.col("x.concept").alias("concept")).agg(F.round(F.min(shared), 4).alias("overlap"))
    count = sets.groupBy("concept").agg(F.count("*").alias("implementations"))
    out = low.join(count, "concept")
    return out.select("concept", "implementations", "overlap", F.when(F.col("overlap") < 0.10, "split_recommended").when(F.col("overlap") < 0.35, "divergent").otherwise("merged").alias("merge_status"))


def nearby(edges: DataFrame, reach: int = 2, most: int = 80) -> DataFrame:
    """(id, near_id, distance): deterministic edges of the same path within ``reach`` lines, nearest first, at most ``most`` per edge.

    The range join goes over (path, line block): each edge looks into the blocks its range covers.
    """
    e = edges.where("stage = 'deterministic' and path is not null and line_start is not null").select("id", "path", "line_start", F.greatest("line_start", F.coalesce("line_end", "line_start")).alias("line_end"))
    block = 64
    probe = e.withColumn("_b", F.explode(F.sequence(F.floor((F.col("line_start") - reach) / block), F.floor((F.col("line_end") + reach) / block))))
    point = e.select(F.col("id").alias("near_id"), "path", F.col("line_start").alias("_at"), F.floor(F.col("line_start") / block).alias("_b"))
    hit = probe.join(point, ["path", "_b"]).where((F.col("_at") >= F.col("line_start") - reach) & (F.col("_at") <= F.col("line_end") + reach) & (F.col("id") != F.col("near_id")))
    order = W.partitionBy("id").orderBy("distance", "near_id")
    return hit.select("id", "near_id", F.abs(F.col("_at") - F.col("line_start")).alias("distance")).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def node_lines(edges: DataFrame) -> DataFrame:
    """(node, outs, ins): a node's edges as distinct sorted `relation target` and `source relation` lines."""
    lines = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    out = edges.groupBy(F.col("src").alias("node")).agg(lines(F.concat_ws(" ", "relation", label(F.col("dst")))).alias("outs"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(lines(F.concat_ws(" ", label(F.col("src")), "relation")).alias("ins"))
    return out.join(into, "node", "full").select("node", F.coalesce("outs", F.lit("")).alias("outs"), F.coalesce("ins", F.lit("")).alias("ins"))


def enclosing_functions(edges: DataFrame, functions: DataFrame, reach: int = 800) -> DataFrame:
    """(id, function): of each edge with a path and a line the last function that begins at or above the line, at most ``reach`` lines.

    An as-of join over (path, block of ``reach`` lines): a line looks into its own block and the one before.
    """
    e = edges.where("path is not null and line_start is not null").select("id", "path", "line_start")
    probe = e.withColumn("_b", F.explode(F.array(F.floor(F.col("line_start") / reach), F.floor(F.col("line_start") / reach) - 1)))
    f = functions.where("path is not null and line_start is not null and name is not null").select("path", F.col("line_start").alias("_at"), F.col("name").alias("function")).distinct()
    hit = probe.join(f.withColumn("_b", F.floor(F.col("_at") / reach)), ["path", "_b"]).where((F.col("_at") <= F.col("line_start")) & (F.col("_at") >= F.col("line_start") - reach))
    return hit.groupBy("id").agg(F.max_by("function", F.struct("_at", "function")).alias("function"))
