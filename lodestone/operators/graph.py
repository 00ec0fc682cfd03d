"""Similarity graphs: construction, PageRank, communities and lookups.

Undirected edges are tables (a, b, w) with a < b; nodes are a table (id). Ranks are
iterated as joins and sums; every few rounds the ranks are written, which bounds the lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.durable import discard, table
from lodestone.operators.components import components
from lodestone.operators.lexical import containing
from lodestone.operators.ranking import placed
from lodestone.operators.vectors import similar_pairs

DAMPING, ITERATIONS, THRESHOLD, NEIGHBOURS = 0.85, 50, 0.62, 8
#: Rounds between two writes of the ranks.
CUT_EVERY = 5


def undirected(pairs: DataFrame) -> DataFrame:
    """One edge for each pair of nodes, with the larger of its weights."""
    return pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w"))


def similarity_graph(vectors: DataFrame, *, threshold: float = THRESHOLD, k: int = NEIGHBOURS, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    return undirected(similar_pairs(vectors, threshold, k, id_col=id_col, vector_col=vector_col))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def _rank(nodes: DataFrame, edges: DataFrame, teleport: DataFrame, *, damping: float, iterations: int, dangling: bool) -> DataFrame:
    """(id, rank) after fixed iterations. ``teleport`` is (id, t); ``dangling`` mass goes there, or is lost."""
    arcs = both_ways(edges)
    arcs = arcs.join(arcs.groupBy("src").agg(F.sum("w").alias("total"), F.count("*").alias("degree")), "src")
    share = F.when(F.col("total") != 0, F.col("w") / F.col("total")).otherwise(1.0 / F.col("degree"))
    arcs = table(arcs.select("src", "dst", share.alias("share")), "arcs")
    base = nodes.join(teleport, "id", "left").select("id", F.coalesce("t", F.lit(0.0)).alias("t"))
    base = base.join(arcs.select(F.col("src").alias("id"), F.lit(True).alias("linked")).distinct(), "id", "left")
    base = table(base.select("id", "t", F.coalesce("linked", F.lit(False)).alias("linked")), "ranked-nodes")
    # Nodes without edges get nothing but teleports, so what they lose is a recurrence of one number.
    own = float(base.where("NOT linked").agg(F.sum("t")).first()[0] or 0.0) if dangling else 0.0
    ranks, lost, ranks_written = base.select("id", "t", F.col("t").alias("rank")), own, None
    for i in range(iterations):
        sent = arcs.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) * F.col("t") + damping * F.coalesce("got", F.lit(0.0)) + damping * lost * F.col("t")
        ranks = base.join(sent, "id", "left").select("id", "t", rank.alias("rank"))
        lost = own * ((1 - damping) + damping * lost)
        if (i + 1) % CUT_EVERY == 0:
            before, ranks = ranks_written, table(ranks, "ranks")
            if before is not None:
                discard(before)
            ranks_written = ranks
    return ranks.select("id", "rank")


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """Weighted PageRank with a uniform teleport and uniform spread of dangling mass."""
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))
    teleport = nodes.crossJoin(n).select("id", (1.0 / F.col("n")).alias("t"))
    return _rank(nodes, edges, teleport, damping=damping, iterations=iterations, dangling=True)


def _teleport(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    own = seeds.join(nodes, "id").select("id", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)).alias("weight"))
    total = F.broadcast(own.agg(F.sum("weight").alias("total"), F.count("*").alias("n")))
    return own.crossJoin(total).select("id", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.col("weight") / F.col("n")).alias("t"))


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """Weighted PageRank towards ``seeds`` (id, weight); no rows if none of them is a node."""
    teleport = _teleport(nodes, seeds)
    ranks = _rank(nodes, edges, teleport, damping=damping, iterations=iterations, dangling=True)
    found = F.broadcast(teleport.agg(F.count("*").alias("seeds")))
    return ranks.crossJoin(found).where("seeds > 0").select("id", "rank")


def term_rank(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, iterations: int = 20) -> DataFrame:
    """Unweighted ranks over a term graph (a, b); mass of seeds outside the graph is lost."""
    flat = edges.select("a", "b", F.lit(1.0).alias("w"))
    nodes = flat.select(F.col("a").alias("id")).union(flat.select("b")).distinct()
    total = F.broadcast(seeds.agg(F.sum("weight").alias("total")))
    teleport = seeds.crossJoin(total).select("id", (F.col("weight") / F.when(F.col("total") != 0, F.col("total")).otherwise(1.0)).alias("t"))
    return _rank(nodes, flat, teleport, damping=damping, iterations=iterations, dangling=False)


def _settled(a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of a component's edges. A node is looked at again only where a neighbour's label has changed since."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends.ravel()[: len(a)], ends.ravel()[len(a) :]
    src, dst, weight = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([w, w])
    order = np.lexsort((dst, src))
    dst, weight = dst[order], weight[order]
    first = np.searchsorted(src[order], np.arange(len(ids) + 1))
    label, stirred = np.arange(len(ids)), np.ones(len(ids), bool)
    for _ in range(rounds):
        moved = False
        for v in range(len(ids)):
            if not stirred[v]:
                continue
            stirred[v] = False
            near = dst[first[v] : first[v + 1]]
            names, at = np.unique(label[near], return_inverse=True)
            # The first maximum is that of the smallest label.
            new = names[np.bincount(at.ravel(), weight[first[v] : first[v + 1]]).argmax()]
            if new != label[v]:
                label[v], moved = new, True
                stirred[near] = True
        if not moved:
            break
    return ids, ids[label]


def label_propagation(nodes: DataFrame, edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """(id, label) by in-place propagation in ascending order of ids, ties to the smaller label.

    A node reads only its neighbours and a settled component stays as it is, so running the same
    sequence within each connected component gives the same labels; components are the unit of work. The sequence
    leaves no way to split one: a task holds a component's edges as flat arrays, some 60 bytes an edge.
    """
    roots = components(edges.select("a", "b"))
    held = edges.join(roots.withColumnRenamed("node", "a"), "a").select("root", "a", "b", "w")

    def settle(group: pa.Table) -> pa.Table:
        ids, labels = _settled(*(group.column(c).to_numpy() for c in ("a", "b", "w")), rounds)
        return pa.table({"id": ids, "label": labels})

    kind = nodes.schema["id"].dataType.simpleString()
    found = held.groupBy("root").applyInArrow(settle, f"id {kind}, label {kind}")
    return nodes.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def communities(labels: DataFrame) -> DataFrame:
    """(label, community, size): communities named c-1, c-2, ... by size, then by their first node."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    return placed(sizes, F.desc("size"), "first").select("label", F.concat(F.lit("c-"), "place").alias("community"), "size")


def top_ranks(ranks: DataFrame, labels: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """The ``limit`` highest ranks (id, rank), with each node's community where labels are given."""
    top = ranks.orderBy(F.desc("rank"), "id").limit(limit)
    if labels is None:
        return top
    named = labels.join(communities(labels), "label").select("id", "community", "size")
    return top.join(named, "id", "left").orderBy(F.desc("rank"), "id")


def community_of(labels: DataFrame, node) -> DataFrame:
    """(id, community): the members of the community that a node belongs to."""
    own = labels.where(F.col("id") == F.lit(node)).select("label")
    named = communities(labels)
    return labels.join(own, "label", "left_semi").join(named, "label").select("id", "community")


def neighbours(edges: DataFrame, node, limit: int = 20) -> DataFrame:
    own = both_ways(edges).where(F.col("src") == F.lit(node))
    return own.select(F.col("dst").alias("id"), "w").orderBy(F.desc("w"), "id").limit(limit)


def statistics(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes, communities, size of the largest."""
    linked = both_ways(edges).select(F.col("src").alias("id")).distinct()
    counts = [nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")), nodes.join(linked, "id", "left_anti").agg(F.count("*").alias("isolated")), labels.groupBy("label").count().agg(F.count("*").alias("communities"), F.max("count").alias("largest"))]
    out = counts[0]
    for more in counts[1:]:
        out = out.crossJoin(more)
    return out


def term_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b) of terms that share a triple, bridge (term, turn)); self loops only bridge."""
    edges = triples.select(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).where("a <> b").distinct()
    bridge = triples.select(F.explode(F.array("subject_id", "object_id")).alias("term"), F.col("turn_id").alias("turn")).distinct()
    return edges, bridge


def _level(score: str, places: int = 12) -> Column:
    """A score to so many places: sums of the same ranks in another order differ in the last ones, and then go by id."""
    return F.round(score, places)


def graph_route(terms: DataFrame, triples: DataFrame, query: str, candidates: DataFrame, *, max_seeds: int = 12, keep: float = 0.2, places: int = 12) -> DataFrame:
    """(id, score) of the turns whose terms rank highest from the terms that the query names.

    Turns of score 0 count towards the share that is kept; at least one turn is. Scores equal to ``places`` places go by id.
    """
    from lodestone.functions.text import normalize_term

    wanted = normalize_term(F.lit(query))
    named = terms.where((F.col("normalized") != "") & F.contains(wanted, F.col("normalized")))
    seeds = named.orderBy(F.desc(F.length("normalized")), "id").limit(max_seeds)
    place = F.row_number().over(Window.orderBy(F.desc(F.length("normalized")), "id"))
    seeds = table(seeds.select("id", (1.0 / place).alias("weight")), "seeds")
    edges, bridge = term_graph(triples)
    ranks = term_rank(edges, seeds)
    allowed = candidates.select(F.col("id").alias("turn"))
    scored = ranks.join(bridge, ranks.id == bridge.term).join(allowed, "turn", "left_semi").groupBy(F.col("turn").alias("id")).agg(F.sum("rank").alias("score"))
    scored = table(scored, "scored-turns")
    kept = scored.orderBy(F.desc(_level("score", places)), "id").limit(max(1, -int(-scored.count() * keep // 1)))
    return kept.crossJoin(F.broadcast(seeds.agg(F.count("*").alias("seeds")))).where("seeds > 0").select("id", "score")


def graph_route_all(terms: DataFrame, triples: DataFrame, queries: DataFrame, allowed, *, max_seeds: int = 12, keep: float = 0.2, damping: float = DAMPING, iterations: int = 20) -> DataFrame:
    """(query_id, id, score): ``graph_route`` of every query (query_id, query) at once; ``allowed`` filters (query_id, id) rows.

    Ranks are kept a query and a term that its seeds reach, so the tables grow with these and not with all terms.
    """
    from lodestone.functions.text import normalize_term

    asked = queries.select(F.col("query_id").alias("id"), normalize_term(F.col("query")).alias("text"))
    named = containing(asked, terms.where("normalized <> ''").select("id", "normalized"), key_col="id", needle_col="normalized").select(F.col("id").alias("query_id"), F.col("key").alias("id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.length("normalized")), "id"))
    seeds = named.join(terms.select("id", "normalized"), "id").withColumn("place", place).where(F.col("place") <= max_seeds).select("query_id", "id", (1.0 / F.col("place")).alias("weight"))
    seeds = seeds.withColumn("t", F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))).drop("weight")
    edges, bridge = term_graph(triples)
    arcs = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a"))
    degree = table(arcs.groupBy("src").agg(F.count("*").alias("degree")), "degrees")
    arcs = table(arcs.join(degree, "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")), "arcs")
    # What seeds outside the graph would hold is lost.
    seeds = table(seeds.join(degree.select(F.col("src").alias("id")), "id", "left_semi"), "seeds")
    ranks, written = seeds.select("query_id", "id", F.col("t").alias("rank")), None
    for i in range(iterations):
        sent = ranks.join(arcs, ranks.id == arcs.src).select("query_id", F.col("dst").alias("id"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        ranks = sent.union(seeds.select("query_id", "id", ((1 - damping) * F.col("t")).alias("rank"))).groupBy("query_id", "id").agg(F.sum("rank").alias("rank"))
        if (i + 1) % CUT_EVERY == 0 or i + 1 == iterations:
            before, ranks = written, table(ranks, "ranks")
            if before is not None:
                discard(before)
            written = ranks
    met = ranks.join(bridge, ranks.id == bridge.term).groupBy("query_id", F.col("turn").alias("id")).agg(F.sum("rank").alias("score"))
    met = table(allowed(met), "scored-turns")
    count = met.groupBy("query_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * keep)).alias("most"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(_level("score")), "id"))
    return met.withColumn("nth", nth).join(count, "query_id").where("nth <= most").select("query_id", "id", "score")


def build_graph(nodes: DataFrame, vectors: DataFrame, path: str, *, threshold: float = THRESHOLD, k: int = NEIGHBOURS, iterations: int = ITERATIONS) -> DataFrame:
    """Similarity edges, ranks and communities of ``vectors`` (id, vector), published under ``path``; one row that sums them up.

    Edges and nodes become current only when they have been read back with as many rows as were built, and every edge ends in a node.
    """
    from lodestone.sources import tables

    edges = table(similarity_graph(vectors, threshold=threshold, k=k), "edges")
    labels = table(label_propagation(nodes, edges), "labels")
    named = labels.join(communities(labels), "label").select("id", "community")
    ranked = pagerank(nodes, edges, iterations=iterations).join(named, "id")
    ends = both_ways(edges).select(F.col("src").alias("id")).distinct()
    if not ends.join(nodes, "id", "left_anti").isEmpty():
        raise ValueError("an edge ends in no node")
    for name, part in (("edges", edges), ("nodes", ranked)):
        tables.publish(part, f"{path}/{name}")
    return statistics(nodes, edges, labels)
