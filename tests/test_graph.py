"""Graph operators against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fusion, graph, vectors
from lodestone.operators.components import components, joined


def random_graph(seed, n=40, m=55):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return list(range(n)), [(a, b, round(r.uniform(0.3, 1), 3)) for a, b in sorted(pairs)]


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long, w double")


def power(nodes, edges, teleport, rounds, damping=0.85):
    index = {n: k for k, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[index[b], index[a]] = m[index[a], index[b]] = w
    sums = m.sum(0)
    m = m / np.where(sums > 0, sums, 1)
    t = np.array([teleport.get(n, 0.0) for n in nodes])
    rank = t.copy()
    for _ in range(rounds):
        rank = (1 - damping) * t + damping * m @ rank + damping * rank[sums == 0].sum() * t
    return dict(zip(nodes, rank))


def test_pagerank(spark):
    nodes, edges = random_graph(1)
    got = dict(graph.pagerank(*frames(spark, nodes, edges), iterations=12).collect())
    want = power(nodes, edges, {n: 1 / len(nodes) for n in nodes}, 12)
    assert got == pytest.approx(want, abs=1e-12) and sum(got.values()) == pytest.approx(1)


def test_personalized(spark):
    nodes, edges = random_graph(2)
    ns, es = frames(spark, nodes, edges)
    seeds = spark.createDataFrame([(3, 2.0), (5, 1.0), (99, 4.0)], "id long, weight double")
    got = dict(graph.personalized_pagerank(ns, es, seeds, iterations=6).collect())
    assert got == pytest.approx(power(nodes, edges, {3: 2 / 3, 5: 1 / 3}, 6), abs=1e-12)
    assert graph.personalized_pagerank(ns, es, seeds.where("id = 99"), iterations=2).count() == 0


def propagate(nodes, edges, rounds=50):
    near = {n: [] for n in nodes}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label = {n: n for n in nodes}
    for _ in range(rounds):
        changed = False
        for v in sorted(nodes):
            votes = {}
            for u, w in near[v]:
                votes[label[u]] = votes.get(label[u], 0) + w
            if votes:
                best = max(votes, key=lambda k: (votes[k], -k))
                changed |= best != label[v]
                label[v] = best
        if not changed:
            break
    return label


@pytest.mark.parametrize("seed", [3, 4])
def test_label_propagation(spark, seed):
    nodes, edges = random_graph(seed)
    ns, es = frames(spark, nodes, edges)
    got = graph.label_propagation(ns, es)
    assert dict(got.collect()) == propagate(nodes, edges)
    names = graph.communities(got).collect()
    sizes = sorted((r["size"] for r in names), reverse=True)
    assert [r["size"] for r in sorted(names, key=lambda r: int(r["community"][2:]))] == sizes and sum(sizes) == len(nodes)


def test_components_of_long_chains(spark):
    r = random.Random(7)
    names = r.sample(range(10_000), 400)
    links = [(a, b) for part in (names[:150], names[150:]) for a, b in zip(part, part[1:])]
    got = dict(components(spark.createDataFrame(links + [(5, 5), (None, 3)], "a long, b long")).collect())
    assert got == {n: min(part) for part in (names[:150], names[150:]) for n in part}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joined_components_are_those_of_all_links(spark):
    r = random.Random(11)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(4, 4), (9, 2), (2, 9), (9, 2)]
    of = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {}
    for a, b in links:
        if a != b:
            one = {n for n in (a, b) for n in want.get(n, {n})}
            want |= {n: one for n in one}
    # The second part repeats some of the first, joins its components and names nodes that it lacks.
    got = joined(components(of(links[:90])), of(links[70:] + [(None, 3)])).collect()
    assert sorted(map(tuple, got)) == sorted((n, min(one)) for n, one in want.items())


def test_similar_pairs_and_cosine(spark):
    x = np.random.default_rng(3).normal(size=(60, 5))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    got = {(r["src"], r["dst"]): r["w"] for r in vectors.similar_pairs(frame, 0.6, 3).collect()}
    want = {}
    for i in range(60):
        order = [j for j in sorted(range(60), key=lambda j: (-s[i, j], j)) if j != i and s[i, j] >= 0.6][:3]
        want |= {(i, j): s[i, j] for j in order}
    assert got == pytest.approx(want)
    one = frame.select(vectors.cosine(F.col("vector"), F.array(*[F.lit(float(v)) for v in x[0]])).alias("c")).collect()
    assert [r["c"] for r in one] == pytest.approx(s[:, 0].tolist(), abs=1e-6)
    packed = frame.select(vectors.blob_to_vector(vectors.vector_to_blob(F.col("vector").cast("array<float>"))).alias("v")).first()["v"]
    assert packed == pytest.approx(x[0].tolist(), rel=1e-6)


def test_fusion_modes(spark):
    rows = lambda xs: spark.createDataFrame([(0, i, s) for i, s in xs], "query_id int, id long, score double")
    lexical, other = rows([(k, 9.0 - k) for k in range(5)]), rows([(9, 0.9), (0, 0.8)])
    order = lambda df: [(r["id"], r["score_kind"]) for r in df.orderBy("position").collect()]
    assert order(fusion.fuse({"bm25": lexical}))[0] == (0, "raw")
    led = rows([(0, 20.0)] + [(k, 5.0 - k) for k in range(1, 5)])
    assert order(fusion.fuse({"bm25": led, "vector": other}, pool=6)) == [(k, "gated") for k in (0, 1, 2, 3, 4, 9)]
    mixed = order(fusion.fuse({"bm25": lexical, "vector": other}))
    assert mixed[0] == (0, "rrf") and len(mixed) == 6


def test_graph_route(spark):
    terms = spark.createDataFrame([("a", "apple"), ("b", "tree"), ("c", "car")], "id string, normalized string")
    triples = spark.createDataFrame([("t1", "a", "b"), ("t2", "b", "c"), ("t3", "c", "c")], "turn_id string, subject_id string, object_id string")
    candidates = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "id string")
    assert [r["id"] for r in graph.graph_route(terms, triples, "An Apple", candidates).collect()] == ["t1"]
    assert graph.graph_route(terms, triples, "nothing", candidates).count() == 0


def test_graph_route_orders_by_the_scores_that_it_shows(spark, tmp_path):
    """Turns far from the question score 0 to six places and go by their ids, whatever is left of their scores behind."""
    import duckdb

    import __spark_entry__ as entry

    chain = ["thing", *(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))]
    said = [f"{chain[k]} {chain[k + 1]}" for k in range(40)] + [f"{w} leaf{w}" for w in chain[:40]]
    rows = [(k, t, role, text) for k, asked in enumerate(said) for t, role, text in ((0, "user", asked), (1, "assistant", "so it is"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    sql = entry.oracle_sql()["graph_route"].replace("count(*) * 0.2", "count(*) * 0.4")
    want = db.execute(sql).fetchall()
    assert len({s for *_, s in want}) < len(want)
    with pytest.MonkeyPatch.context() as patch:
        route = graph.graph_route
        patch.setattr(graph, "graph_route", lambda *a, **more: route(*a, **more, keep=0.4))
        got = [tuple(r) for r in entry.queries()["graph_route"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
