"""Recall of many queries against one at a time, and pre-steps as a job that may be repeated."""

from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import recall
from lodestone.plans import testdata as td

SF = "/root/testdata/sf0.001"


def _rows(df, *more):
    return sorted(tuple(r) for r in df.select(*more, "id", "position", "score", "score_kind").collect())


def test_many_queries_get_what_each_gets_alone(spark):
    turns = td.turns(spark, SF).cache()
    store = recall.Store(turns, postings=recall.build_postings(turns).cache())
    said = [r["user_text"] for r in turns.orderBy("id").limit(2).collect()]
    queries = [("q0", said[0]), ("q1", said[1][:40]), ("q2", "ok"), ("q3", "zzqqxx " + said[0][-9:-1]), ("q4", "qqqqzzzzz")]
    got = recall.recall_all(store, spark.createDataFrame(queries, "query_id string, query string"), recall.Options(k=3)).cache()
    for name, query in queries:
        alone = recall.recall(store, query, recall.Options(k=3))
        assert _rows(got.where(F.col("query_id") == name)) == _rows(alone), name
    assert got.where("query_id = 'q2'").count() == 0 and got.where("query_id = 'q0'").count() == 3


def test_the_graph_route_of_many_queries(spark):
    terms = spark.createDataFrame([(f"n{k}", w) for k, w in enumerate(["blue", "elephant", "paint", "dry", "far"])], "id string, normalized string")
    triples = spark.createDataFrame([("t1", "n0", "n1"), ("t2", "n1", "n2"), ("t3", "n2", "n3"), ("t4", "n4", "n4")], "turn_id string, subject_id string, object_id string")
    turns = spark.createDataFrame([(f"t{k}",) for k in range(1, 5)], "id string")
    queries = [("a", "the Blue elephant"), ("b", "dry paint")]
    got = graph.graph_route_all(terms, triples, spark.createDataFrame(queries, "query_id string, query string"), lambda r: r.join(turns, "id", "left_semi"), keep=0.6)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["query_id"], {})[r["id"]] = round(r["score"], 9)
    for name, query in queries:
        alone = {r["id"]: round(r["score"], 9) for r in graph.graph_route(terms, triples, query, turns, keep=0.6).collect() if r["score"] > 0}
        assert rows.get(name, {}) == alone, name


def test_pre_steps_of_all_sessions_and_a_repeated_batch(spark, tmp_path):
    from lodestone.plans import catalogue_jobs as jobs

    path = str(tmp_path / "job")
    store, messages = jobs._store(spark, SF), jobs._messages(spark, SF)
    source = str(tmp_path / "in")
    messages.coalesce(1).write.json(source)
    stream = spark.readStream.schema(messages.schema).json(source)
    for _ in range(2):
        recall.pre_step_job(stream, store, path, 9).awaitTermination(200)
    held = lambda: (sorted(map(tuple, recall.ledger(spark, path).collect())), sorted(tuple(r) for r in spark.read.parquet(f"{path}/recalled").select("session", "id", "position", "block").collect()))
    first = held()
    # The batch's folders are written once more, as after a lost driver.
    noted, recalled = recall.pre_steps(store, messages, 9)
    noted.write.mode("overwrite").parquet(f"{path}/ledger/batch=0")
    recalled.write.mode("overwrite").parquet(f"{path}/recalled/batch=0")
    assert held() == first and first[0] and first[1]
    # Each session is told what it would be told alone.
    session = first[1][0][0]
    empty = spark.createDataFrame([], "session string, id string, at long")
    _, alone, text = recall.pre_step(store, session, messages, empty, 9, inject=True)
    assert sorted((session, r["id"], r["position"], r["block"]) for r in alone.collect()) == [r for r in first[1] if r[0] == session] and text
