"""Connected components of a link table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.durable import discard, table


#: Links that a task writes; a table of few links is then few files, however many partitions its shuffles have.
TASK_LINKS, LEAST_TASKS = 1 << 16, 8


def _written(edges: DataFrame, links: int) -> DataFrame:
    """``edges`` as a table, of about as many as the ``links`` counted before; only the tasks that write it are fewer, never its shuffles."""
    return table(edges.coalesce(max(LEAST_TASKS, -(-links // TASK_LINKS))), "links")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node of its component.

    Alternates two star contractions until the table stays as it is: each hangs a
    node's neighbours on the smallest of them. Aggregates are minima, which Spark
    combines before the shuffle, and the joins are ones that it can split, so a
    node with very many links doesn't meet in one task. Null and self links count for nothing.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = table(edges, "links")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = _written(large, state[0])  # no more rows than links; what repeats goes with the small stars
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()
        before, edges = edges, _written(small, state[0])
        discard(before, large)
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components didn't settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components that ``links`` (a, b) make of those of ``roots`` (node, root).

    Only the links between components are contracted, so what is settled is never walked again. A node that ``roots`` lacks is a component by itself.
    """
    ends = links.select("a", "b")
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias("to"))
        ends = ends.join(own, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    above = table(components(ends), "joined")
    moved = above.select(F.col("node").alias("root"), F.col("root").alias("to"))
    held = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return held.union(above.join(roots.select("node"), "node", "left_anti").select("node", "root"))
