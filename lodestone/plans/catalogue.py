"""The engine's own queries by name, each with SQL for the same rows where SQL can express it.

Queries read whole tables. Scores are rounded to six places on both sides, as sums of doubles
depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import table
from lodestone.functions import text as tx
from lodestone.operators import evidence, facts, fusion, graph, injection, lexical, repetition, sessions, store
from lodestone.operators import vectors as vec
from lodestone.operators.components import components
from lodestone.plans import memory, recall
from lodestone.plans import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_WS = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_QUESTION = "the thing of worthless tion and the er"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from lodestone.plans import catalogue_jobs, catalogue_sources, catalogue_store, catalogue_streams  # noqa: F401  (their queries add themselves)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir)


# ---- SQL fragments -----------------------------------------------------------


def _tokens(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    rest = f"string_split(regexp_replace({low}, '[a-z0-9_{_WS}]+', '', 'g'), '')"
    return f"list_concat(regexp_extract_all({low}, '[a-z0-9_]+'), CASE WHEN length(regexp_replace({low}, '[a-z0-9_{_WS}]+', '', 'g')) < 2 THEN [] ELSE list_transform(generate_series(1, len({rest}) - 1), lambda i: ({rest})[i] || ({rest})[i + 1]) END)"


def _tokens_cte(source: str) -> str:
    """toks(id, t) of ``source`` (id, text), whose pieces are computed once."""
    return f"""l0 AS (SELECT id, lower(coalesce(text, '')) AS low FROM ({source})),
l1 AS (SELECT id, regexp_extract_all(low, '[a-z0-9_]+') AS ws, regexp_replace(low, '[a-z0-9_{_WS}]+', '', 'g') AS rest FROM l0),
l2 AS (SELECT id, ws, CASE WHEN length(rest) < 2 THEN [] ELSE string_split(rest, '') END AS c FROM l1),
toks AS (SELECT id, list_concat(ws, list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1])) AS t FROM l2)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"
_POST = "post AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks)"


def _bm25_sql(terms: str, k1: float = 1.5, idf: str = "ln(1 + (n - df + 0.5) / (df + 0.5))") -> str:
    return f"""sc AS (SELECT query_id, id, sum({idf} * (tf * ({k1} + 1)) / (tf + {k1} * (0.25 + 0.75 * len / avgdl))) AS score FROM post JOIN ({terms}) q USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _question(spark: SparkSession, text: str = _QUESTION) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id int, query string")


def _items_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    text = F.concat_ws(" ", tx.text("text"), F.concat_ws(" ", "lang", "source"))
    return lexical.stored_index(spark, f"{sf_dir}/documents.parquet", "doc_id", text)


def _index(spark: SparkSession, sf_dir: str, full_text: bool = False) -> lexical.Index:
    return lexical.stored_index(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", full_text)


# ---- lexical -------------------------------------------------------------------


@query(f"WITH {_tokens_cte(_DOCS)}, {_POST} SELECT term, df, CAST(sum(tf) AS BIGINT) AS occurrences FROM post JOIN df USING (term) GROUP BY term, df")
def lexical_index(spark, sf_dir):
    """What the stored postings hold; the first query that asks for them builds them."""
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {_tokens_cte(_DOCS)} SELECT id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_tokens FROM toks")
def tokenize_counts(spark, sf_dir):
    t = _documents(spark, sf_dir).select("id", tx.tokenize("text").alias("t"))
    return t.select("id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


@query(f"WITH {_tokens_cte(_DOCS)}, {_POST} SELECT term, df FROM df")
def term_df(spark, sf_dir):
    return lexical.document_frequency(lexical.postings(_documents(spark, sf_dir)))


@query(f"WITH {_tokens_cte(_DOCS)} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM toks")
def doc_lengths(spark, sf_dir):
    return lexical.corpus_stats(_documents(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_tokens_cte("SELECT doc_id AS id, concat_ws(' ', text, lang, source) AS text FROM documents")} SELECT id AS doc, CAST(len(t) AS BIGINT) AS len FROM toks")
def items_index(spark, sf_dir):
    """How long the items are in the stored postings of their contents and keywords."""
    return _items_index(spark, sf_dir).lengths.select("doc", F.col("len").cast("long").alias("len"))


_Q1 = f"SELECT 0 AS query_id, unnest(list_distinct(string_split('{_QUESTION}', ' '))) AS term"


@query(f"WITH {_tokens_cte(_DOCS)}, {_POST}, {_bm25_sql(_Q1)} SELECT id AS doc, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 10")
def bm25_topk(spark, sf_dir):
    index, terms = _index(spark, sf_dir), lexical.query_terms(_question(spark))
    scored = lexical.bm25(index.of(terms), index.stats(), terms)
    return lexical.top_k(scored, 10).select("doc", F.round("score", 6).alias("score"))


_FTS = f"""l0 AS (SELECT id, lower(coalesce(text, '')) AS low FROM ({_DOCS})),
l1 AS (SELECT id, regexp_extract_all(low, '[a-z0-9_]+') AS ws, regexp_replace(low, '[a-z0-9_{_WS}]+', '', 'g') AS rest FROM l0),
l2 AS (SELECT id, ws, CASE WHEN length(rest) < 2 THEN [] ELSE string_split(rest, '') END AS c FROM l1),
toks AS (SELECT id, regexp_extract_all(translate(array_to_string(list_concat(ws, list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1])), ' '), '{lexical._ACCENTED}', '{lexical._PLAIN}'), '[\\p{{L}}\\p{{N}}]+') AS t FROM l2)"""


@query(f"WITH {_FTS}, {_POST}, {_bm25_sql(_Q1, 1.2, 'CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END')} SELECT id AS doc, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 10")
def bm25_fts_topk(spark, sf_dir):
    index = _index(spark, sf_dir, full_text=True)
    terms = _question(spark).select("query_id", F.explode(F.array_distinct(lexical.full_text_tokens("query"))).alias("term"))
    scored = lexical.bm25_full_text(index.of(terms), index.stats(), terms)
    return lexical.top_k(scored, 10).select("doc", F.round("score", 6).alias("score"))


def _query_set(spark, sf_dir) -> DataFrame:
    return td.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _ranked_set(spark, sf_dir, k: int) -> DataFrame:
    index, terms = _index(spark, sf_dir), lexical.query_terms(_query_set(spark, sf_dir))
    return lexical.bm25_best(index.of(terms), index.stats(), terms, k).drop("n")


_QSET = f"SELECT query_id, unnest(list_distinct(t)) AS term FROM (SELECT item_id AS query_id, {_tokens('text')} AS t FROM benchmark)"
_RANKED = f"WITH {_tokens_cte(_DOCS)}, {_POST}, {_bm25_sql(_QSET)}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM sc)"


@query(f"{_RANKED} SELECT query_id, id AS doc, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank < 5")
def bm25_query_set(spark, sf_dir):
    return _ranked_set(spark, sf_dir, 5).select("query_id", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_TRUTH = "truth AS (SELECT item_id AS query_id, min(doc_id) AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"


@query(f"{_RANKED}, {_TRUTH}, f AS (SELECT query_id, min(rank) AS rank FROM truth LEFT JOIN (SELECT * FROM rk WHERE rank < 50) USING (query_id, id) GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN rank < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank < 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN rank < 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr FROM f")
def recall_at_k(spark, sf_dir):
    held = lexical.containing(td.read(spark, sf_dir, "documents"), _query_set(spark, sf_dir), id_col="doc_id")
    truth = held.groupBy(F.col("key").alias("query_id")).agg(F.min("id").alias("id"))
    return fusion.recall_at(_ranked_set(spark, sf_dir, 50).withColumnRenamed("doc", "id"), truth)


# ---- vectors and fusion ----------------------------------------------------------


_COS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"


def _vector_route(spark, sf_dir, k: int) -> DataFrame:
    vs = td.vectors(spark, sf_dir)
    asked = vs.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return vec.top_similar(vs, asked, k)


@query(f"WITH {_COS}, s AS (SELECT a.id AS query_id, b.id, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM v a, v b WHERE a.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS r FROM s) SELECT query_id, id, round(s, 6) AS score FROM r WHERE r <= 5")
def cosine_topk(spark, sf_dir):
    return _vector_route(spark, sf_dir, 5).select("query_id", "id", F.round("score", 6).alias("score"))


_PAIRS = f"{_COS}, s AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.e, b.e) / (a.n * b.n) AS w FROM v a JOIN v b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM s WHERE w >= 0.3), pairs AS (SELECT src, dst, w FROM k WHERE r <= 8), edges AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM pairs GROUP BY 1, 2)"


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vs = td.vectors(spark, sf_dir)
    return vs.select("id"), table(graph.similarity_graph(vs, threshold=0.3), "edges")


@query(f"WITH {_PAIRS} SELECT src, dst, round(w, 6) AS w FROM pairs")
def knn_edges(spark, sf_dir):
    return vec.similar_pairs(td.vectors(spark, sf_dir), 0.3, 8).select("src", "dst", F.round("w", 6).alias("w"))


@query(f"WITH {_PAIRS} SELECT a, b, round(w, 6) AS w FROM edges")
def edge_undirected_max(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("a", "b", F.round("w", 6).alias("w"))


@query(f"WITH {_PAIRS}, arcs AS (SELECT a AS id, w FROM edges UNION ALL SELECT b, w FROM edges) SELECT v.id, count(arcs.w) AS degree, round(coalesce(sum(w), 0), 6) AS strength FROM v LEFT JOIN arcs ON v.id = arcs.id GROUP BY v.id")
def degree_stats(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    arcs = graph.both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    return nodes.join(arcs, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("strength", F.lit(0.0)), 6).alias("strength"))


def _rank_sql(rounds: int, teleport: str) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, t, t AS rank FROM tele)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT p.id, p.t, 0.15 * p.t + 0.85 * coalesce(g.got, 0) + 0.85 * p.t * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM share)) AS rank FROM r{i - 1} p LEFT JOIN (SELECT dst, sum(rank * s) AS got FROM share JOIN r{i - 1} ON id = src GROUP BY dst) g ON g.dst = p.id)")
    return f"WITH {_PAIRS}, arcs AS (SELECT a AS src, b AS dst, w FROM edges UNION ALL SELECT b, a, w FROM edges), share AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM arcs), tele AS MATERIALIZED ({teleport}), {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(10, "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS t FROM v"))
def pagerank_10(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.pagerank(nodes, edges, iterations=10).select("id", F.round("rank", 6).alias("rank"))


@query(_rank_sql(50, "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS t FROM v"))
def pagerank_50(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.pagerank(nodes, edges).select("id", F.round("rank", 6).alias("rank"))


@query(_rank_sql(20, "SELECT id, CASE id WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.25 WHEN 3 THEN 0.25 ELSE 0 END AS t FROM v"))
def ppr_seeds(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    seeds = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0), (-5, 9.0)], "id long, weight double")
    return graph.personalized_pagerank(nodes, edges, seeds, iterations=20).select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH RECURSIVE {_PAIRS}, arcs AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), r(id, o) AS (SELECT id, id FROM v UNION SELECT r.id, arcs.b FROM r JOIN arcs ON r.o = arcs.a) SELECT id, min(o) AS root FROM r GROUP BY id")
def graph_components(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    roots = components(edges).withColumnRenamed("node", "id")
    return nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


@query()
def label_propagation(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.label_propagation(nodes, edges)


@query()
def community_sizes(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.communities(graph.label_propagation(nodes, edges))


@query()
def graph_statistics(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.statistics(nodes, edges, graph.label_propagation(nodes, edges))


@query(f"WITH {_PAIRS}, arcs AS (SELECT a AS src, b AS id, w FROM edges UNION ALL SELECT b, a, w FROM edges) SELECT id, round(w, 6) AS w FROM arcs WHERE src = 7 ORDER BY arcs.w DESC, id LIMIT 20")
def graph_neighbours(spark, sf_dir):
    return graph.neighbours(_graph(spark, sf_dir)[1], 7).select("id", F.round("w", 6).alias("w"))


def _routes(spark, sf_dir, *names: str) -> dict[str, DataFrame]:
    """For each item, the best documents by BM25 and, as another route (in the vector route's place), by shared words without weights; ``n`` is how many there are."""
    index, terms = _index(spark, sf_dir), lexical.query_terms(_query_set(spark, sf_dir))
    found = index.of(terms)
    routes = {
        "bm25": lambda: lexical.bm25_best(found, index.stats(), terms, fusion.POOL),
        "vector": lambda: lexical.best_of_each(found, terms.withColumn("weight", F.lit(1.0)), 1 / F.col("len"), fusion.POOL),
    }
    return {n: table(routes[n]().select("query_id", F.col("doc").alias("id"), "score", "n"), f"route-{n}") for n in names or routes}


_TWO = f"{_RANKED}, sh AS (SELECT query_id, id, count(*) * 1.0::DOUBLE / any_value(len) AS score FROM post JOIN ({_QSET}) q USING (term) GROUP BY ALL), r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM sh)"


def _rrf_sql(wb: float, wv: float) -> str:
    return f"{_TWO}, u AS (SELECT query_id, id, {wb} / (60 + rank + 1) AS s FROM rk WHERE rank < 10 UNION ALL SELECT query_id, id, {wv} / (60 + rank + 1) FROM r2 WHERE rank < 10) SELECT query_id, id, round(CAST(sum(s) AS DOUBLE), 6) AS score FROM u GROUP BY ALL"


@query(_rrf_sql(1.0, 1.0))
def rrf_fuse(spark, sf_dir):
    return fusion.reciprocal_rank(_routes(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_rrf_sql(1.0, 0.6))
def rrf_weighted(spark, sf_dir):
    return fusion.reciprocal_rank(_routes(spark, sf_dir), weights=fusion.ROUTE_WEIGHTS).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"{_RANKED}, g AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 0) AS s1, max(score) FILTER (rank = 1) AS s2 FROM rk GROUP BY 1) SELECT query_id, n, round(CASE WHEN s2 > 0 THEN s1 / s2 END, 6) AS gap, n >= 5 AND (s2 IS NULL OR s2 <= 0 OR s1 / s2 >= 1.5) AS open FROM g")
def route_gap(spark, sf_dir):
    found = fusion.gate(_routes(spark, sf_dir, "bm25")["bm25"])
    return found.select("query_id", "n", F.when(F.col("gap") != float("inf"), F.round("gap", 6)).alias("gap"), "open")


@query(
    f"""{_TWO}, g AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 0) AS s1, max(score) FILTER (rank = 1) AS s2 FROM rk GROUP BY 1),
o AS (SELECT query_id, n >= 5 AND (s2 IS NULL OR s2 <= 0 OR s1 / s2 >= 1.5) AS open FROM g),
p AS (SELECT query_id, id, score, rank, 0 AS place FROM rk WHERE rank < 10 UNION ALL SELECT query_id, id, score, rank, 1 FROM r2 WHERE rank < 10),
p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY place, rank) AS nth FROM p JOIN o USING (query_id)),
gt AS (SELECT query_id, id, score, 'gated' AS score_kind, row_number() OVER (PARTITION BY query_id ORDER BY place, rank) - 1 AS position FROM p1 WHERE open AND nth = 1),
rf AS (SELECT query_id, id, sum(CASE place WHEN 0 THEN 1.0::DOUBLE ELSE 0.6 END / (60 + rank + 1)) AS score FROM p1 WHERE NOT open GROUP BY ALL),
rp AS (SELECT query_id, id, score, 'rrf' AS score_kind, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS position FROM rf)
SELECT query_id, id, round(score, 6) AS score, score_kind, CAST(position AS BIGINT) AS position FROM (SELECT * FROM gt WHERE position < 10 UNION ALL SELECT * FROM rp)"""
)
def fuse_gated(spark, sf_dir):
    found = fusion.fuse(_routes(spark, sf_dir))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "score_kind", F.col("position").cast("long").alias("position"))


# ---- sessions --------------------------------------------------------------------


@query(f"WITH {td.TURNS} SELECT session, turn_index, user_seq, answer_seq, user_text, answer_text FROM turns")
def turns_projected(spark, sf_dir):
    return sessions.completed_turns(td.log(spark, sf_dir)).select("session", "turn_index", "user_seq", "answer_seq", "user_text", "answer_text")


@query(f"WITH {td.TURNS} SELECT session, CAST(t - 1 AS INTEGER) AS index, user_seq, user_seq AS from_seq, coalesce(lead(user_seq) OVER (PARTITION BY session ORDER BY t) - 1, last) AS to_seq, events FROM ends")
def turn_windows(spark, sf_dir):
    return sessions.turn_windows(td.log(spark, sf_dir))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1")
def turn_counts(spark, sf_dir):
    return sessions.user_turns(td.log(spark, sf_dir))


@query(
    f"""WITH log AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, role, trim(regexp_replace(text, '[{_WS}]+', ' ', 'g')) AS text FROM conversations),
n AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM log),
f AS (SELECT session, g, min(seq) FILTER (role = 'user' AND text <> '') AS user_seq FROM n WHERE g > 0 GROUP BY ALL)
SELECT f.session, CAST(f.g AS INTEGER) AS abs, f.user_seq, coalesce(substr(l.text, 1, 48), '') AS quote FROM f LEFT JOIN log l ON l.session = f.session AND l.seq = f.user_seq"""
)
def first_user_per_group(spark, sf_dir):
    # What the system says begins a group here.
    events = td.log(spark, sf_dir).withColumn("type", F.when(F.col("kind") == "plugin", "turn/start").otherwise(F.col("type")))
    return sessions.groups(events)


_SAID = "said AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')"


@query(f"WITH {_SAID}, b AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM said WINDOW w AS (PARTITION BY session ORDER BY seq DESC)) SELECT session, seq, role, text FROM b WHERE nth <= 2 OR later < 2")
def tail_with_users(spark, sf_dir):
    return sessions.tail_with_users(sessions.dialogue(td.log(spark, sf_dir)), 2)


@query(f"WITH {td.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn_index DESC) AS nth FROM turns) SELECT session AS session_id, turn_index, user_seq FROM r WHERE nth <= 3")
def recent_turns(spark, sf_dir):
    return sessions.recent_turns(td.turns(spark, sf_dir), 3).select("session_id", "turn_index", "user_seq")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, f ORDER BY event_id) AS run FROM e)
SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM g WHERE f GROUP BY user_id, run HAVING count(*) >= 2"""
)
def islands_segments(spark, sf_dir):
    return sessions.islands(td.read(spark, sf_dir, "events"), F.col("event_type").isin("click", "view"), by=["user_id"], order="event_id")


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
r AS (SELECT conv_id, turn, pos, CASE WHEN n <= 800 THEN n + 1 ELSE 0 END AS used, n <= 800 AS included FROM c WHERE pos = 1
  UNION ALL SELECT c.conv_id, c.turn, c.pos, CASE WHEN r.used + c.n <= 800 THEN r.used + c.n + 1 ELSE r.used END, r.used + c.n <= 800 FROM r JOIN c ON c.conv_id = r.conv_id AND c.pos = r.pos + 1)
SELECT conv_id, turn, included FROM r"""
)
def greedy_pack(spark, sf_dir):
    c = td.read(spark, sf_dir, "conversations")
    return injection.pack_greedy(c, by="conv_id", order="turn", size=F.length("text"), most=800).select("conv_id", "turn", "included")


@query(f"WITH {td.TURNS} SELECT session, CAST(sum(length(user_text)) AS BIGINT) AS user_chars, CAST(sum(length(answer_text)) AS BIGINT) AS answer_chars, count(*) AS turns FROM turns GROUP BY session")
def session_stats(spark, sf_dir):
    return td.turns(spark, sf_dir).groupBy(F.col("session_id").alias("session")).agg(F.sum(F.length("user_text")).alias("user_chars"), F.sum(F.length("answer_text")).alias("answer_chars"), F.count("*").alias("turns"))


@query(f"WITH {td.TURNS} SELECT count(*) AS turns, count(DISTINCT session) AS sessions, count(*) FILTER (answer_seq % 2 = 0) AS completed, count(*) FILTER (answer_seq % 2 <> 0) AS partial, 0::BIGINT AS failed, 0::BIGINT AS informational, 0::BIGINT AS unknown FROM turns")
def outcome_counts(spark, sf_dir):
    return store.store_stats(td.turns(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {td.TURNS}, c AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, role, text FROM conversations),
n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t FROM c),
m AS (SELECT n.*, e.answer_seq, max(n.t) OVER (PARTITION BY n.session) AS turns FROM n LEFT JOIN ends e ON e.session = n.session AND e.t = n.t WHERE n.t > 0),
s AS (SELECT session, max(turns) AS turns, count(DISTINCT CASE WHEN t <= turns - 1 AND answer_seq IS NOT NULL THEN t END) AS foldable_turns, sum(CASE WHEN t <= turns - 1 AND role = 'assistant' AND seq < answer_seq THEN length(text) ELSE 0 END) AS visible_chars, sum(CASE WHEN t <= turns - 1 THEN length(text) ELSE 0 END) AS total_chars FROM m GROUP BY session)
SELECT session, CAST(turns AS INTEGER) AS turns, foldable_turns, CAST(total_chars AS BIGINT) AS total_chars FROM s"""
)
def takeover_estimate(spark, sf_dir):
    return sessions.estimate(td.log(spark, sf_dir), keep=1).select("session", "turns", "foldable_turns", F.col("total_chars").cast("long").alias("total_chars"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, max(length(text) + turn * 10) AS normal_peak, 0::BIGINT AS compaction_peak FROM conversations WHERE role = 'assistant' GROUP BY 1")
def peak_usage(spark, sf_dir):
    return sessions.usage_peaks(td.log(spark, sf_dir))


@query(f"WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, role, text FROM conversations) SELECT session, seq, CASE WHEN role = 'assistant' THEN 'assistant/message' ELSE 'user/message' END AS type, CAST(length(trim(text)) AS INTEGER) AS chars, CASE WHEN length(trim(text)) > 200 THEN substr(trim(text), 1, 200) || '…[+' || (length(trim(text)) - 200) || '字]' ELSE trim(text) END AS text FROM l")
def event_summaries(spark, sf_dir):
    return sessions.summarize(td.log(spark, sf_dir), 200).select("session", "seq", "type", "chars", "text")


# ---- store, queue, streams as batches -----------------------------------------


def _results(spark, sf_dir) -> DataFrame:
    """Events as results of extraction: those of a low value fail."""
    e = td.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.lit(0).alias("user_seq"), F.lit(1).alias("answer_seq"), F.col("event_id").alias("at"), (F.col("event_id") % 5 != 0).alias("ok"), F.col("event_type").alias("error"))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, max(event_id) AS completed_turn FROM events GROUP BY 1")
def watermark_max(spark, sf_dir):
    return store.watermarks(td.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("completed_turn")))


@query(
    """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (event_id % 5 = 0) AS attempts, max(event_id) AS last FROM events GROUP BY 1),
l AS (SELECT f.*, last % 5 <> 0 AS ok, e.event_type AS error FROM f JOIN events e ON e.event_id = f.last)
SELECT session_id, CASE WHEN ok THEN 'succeeded' WHEN attempts >= 3 THEN 'quarantined' ELSE 'pending' END AS state, CAST(attempts AS INTEGER) AS attempts,
  CASE WHEN NOT ok AND attempts < 3 THEN last + CAST(least(3600000, 60000 * pow(2, attempts - 1)) AS BIGINT) END AS next_retry_at, CASE WHEN NOT ok THEN error END AS last_error FROM l"""
)
def queue_fold(spark, sf_dir):
    return store.fold_queue(_results(spark, sf_dir)).select("session_id", "state", "attempts", "next_retry_at", "last_error")


@query("SELECT CAST(range AS INTEGER) AS attempts, CAST(least(3600000, 60000 * pow(2, range - 1)) AS BIGINT) AS backoff FROM range(1, 12)")
def backoff_schedule(spark, sf_dir):
    return spark.range(1, 12).select(F.col("id").cast("int").alias("attempts"), store.backoff(F.col("id")).alias("backoff"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS pos FROM events),
r AS (SELECT user_id, event_id, pos, ms AS last, TRUE AS fire FROM e WHERE pos = 1
  UNION ALL SELECT e.user_id, e.event_id, e.pos, CASE WHEN e.ms - r.last >= 86400000 THEN e.ms ELSE r.last END, e.ms - r.last >= 86400000 FROM r JOIN e ON e.user_id = r.user_id AND e.pos = r.pos + 1)
SELECT user_id, event_id FROM r WHERE fire"""
)
def throttle(spark, sf_dir):
    e = td.read(spark, sf_dir, "events").select("user_id", "event_id", td.millis("ts").alias("at"))
    return store.throttle(e, td.DAY, by=["user_id"], tie="event_id").select("user_id", "event_id")


@query("WITH e AS (SELECT event_id, epoch_ms(ts) AS ms, lag(epoch_ms(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before IS NULL OR ms - before > 1800000 AS fresh FROM e")
def ttl_seen(spark, sf_dir):
    e = td.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct(td.millis("ts"), "event_id").alias("o"), td.millis("ts").alias("at"))
    return store.seen_within(e, 1_800_000, by=["user_id", "event_type"]).select("event_id", "fresh")


@query("WITH o AS (SELECT doc_id AS id, CAST(doc_id * 3 AS VARCHAR) AS u FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS id, CAST(CASE WHEN doc_id % 7 = 0 THEN doc_id ELSE doc_id * 3 END AS VARCHAR) AS u FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'deleted' WHEN o.u <> n.u THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n ON o.id = n.id")
def index_diff(spark, sf_dir):
    d = td.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    old = d.where("id % 3 <> 0").select("id", (F.col("id") * 3).alias("updated_at"))
    new = d.where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.col("id")).otherwise(F.col("id") * 3).alias("updated_at"))
    return store.index_diff(old, new)


@query("SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source ORDER BY documents DESC, source LIMIT 5")
def top_by_source(spark, sf_dir):
    d = td.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    return d.orderBy(F.desc("documents"), "source").limit(5)


# ---- text functions ---------------------------------------------------------------


def _redact_sql(x: str) -> str:
    for name, pattern in tx.SECRET_RULES:
        x = f"regexp_replace({x}, '{pattern.replace('{0,4000}?', '{0,1000}?')}', '{tx.REDACTED}{name}]', 'g')"
    labeled = tx.LABELED_SECRET.replace("'", "''")
    return f"regexp_replace({x}, '{labeled}', '\\1{tx.REDACTED}credential]', 'g')"


@query(f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted_sha, {_redact_sql('text')} <> text AS has_secret FROM documents")
def redact_labeled(spark, sf_dir):
    d = td.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(tx.redact("text"), 256).alias("redacted_sha"), tx.has_secret("text").alias("has_secret"))


_KIND_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace('{0,4000}?', '{0,1000}?').replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in [*tx.SECRET_RULES, ("credential", tx.LABELED_SECRET)])


@query(f"SELECT doc_id, coalesce(array_to_string(list_filter([{_KIND_SQL}], lambda k: k IS NOT NULL), ','), '') AS kinds FROM documents")
def secret_kinds(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.secret_kinds("text"), ",").alias("kinds"))


def _informative_sql(x: str) -> str:
    x = f"lower(regexp_replace(regexp_replace(regexp_replace({x}, '\\[表情:[^\\]]*\\]', ' ', 'g'), '【[^】]*】', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for w in tx.FILLERS:
        x = f"replace({x}, '{w}', ' ')"
    return f"CAST(length(regexp_replace({x}, '[{_WS}]+', '', 'g')) AS INTEGER)"


@query(f"SELECT doc_id, {_informative_sql('text')} AS informative FROM documents")
def informative_length(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", tx.informative_length("text").alias("informative"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {f}::DOUBLE" for _, f, p in tx.ECHO_RULES) + " ELSE 1.0 END AS factor FROM documents")
def echo_factor(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", tx.echo("text")["factor"].alias("factor"))


_SENT = "[。！？!?\\n]+|\\.[" + _WS + "]+"
_PARTS = f"""t AS (SELECT doc_id, CASE WHEN length(text) > 4000 THEN right(text, 4000) ELSE text END AS s FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(s, '{_SENT}'), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS parts FROM t)"""


@query(
    f"""WITH {_PARTS}, u AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS unit FROM p),
c AS (SELECT doc_id, any_value(n) AS n, unit, count(*) AS c FROM u WHERE length(unit) <= 30 AND regexp_matches(unit, '[A-Za-z0-9一-鿿]') GROUP BY doc_id, unit),
m AS (SELECT doc_id, any_value(n) AS n, max(c) AS c FROM c GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(m.c, 0) AS INTEGER) AS count, coalesce(m.n >= 25 AND m.c >= 25 AND m.c * 1.0::DOUBLE / m.n >= 0.2, FALSE) AS hit FROM p LEFT JOIN m USING (doc_id)"""
)
def repeat_detect(spark, sf_dir):
    found = repetition.repeated_units(td.read(spark, sf_dir, "documents"), "doc_id")
    return found.select(F.col("id").alias("doc_id"), F.coalesce("count", F.lit(0)).cast("int").alias("count"), "hit")


@query(
    f"""WITH t AS (SELECT doc_id, regexp_replace(CASE WHEN length(text) > 4000 THEN right(text, 4000) ELSE text END, '```(?s:.*?)```', ' ', 'g') AS s FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(s, '{_SENT}'), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS parts FROM t),
u AS (SELECT doc_id, unnest(parts) AS unit FROM p),
c AS (SELECT doc_id, unit, count(*) AS c FROM u WHERE regexp_matches(unit, '[A-Za-z0-9一-鿿]') GROUP BY ALL),
r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS r FROM c),
top AS (SELECT doc_id, sum(c) AS top FROM r WHERE r <= 5 GROUP BY doc_id),
sh AS (SELECT doc_id, count(*) FILTER (len(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(unit), '\\d+', '#', 'g'), '[^a-z#{_WS}]', ' ', 'g'), '[{_WS}]+'), lambda w: w <> '')) <= 3) AS short FROM u GROUP BY doc_id)
SELECT p.doc_id, CAST(len(parts) AS INTEGER) AS parts, round(short * 1.0::DOUBLE / nullif(len(parts), 0), 6) AS short_share, round(coalesce(top, CASE WHEN len(parts) > 0 THEN 0 END) * 1.0::DOUBLE / nullif(len(parts), 0), 6) AS top_share FROM p LEFT JOIN top USING (doc_id) LEFT JOIN sh USING (doc_id)"""
)
def rotation_detect(spark, sf_dir):
    found = repetition.rotation(td.read(spark, sf_dir, "documents"), "doc_id")
    return found.select(F.col("id").alias("doc_id"), "parts", F.round("short_share", 6).alias("short_share"), F.round("top_share", 6).alias("top_share"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{tx.FACT_WORDS}') AND regexp_matches(text, '{tx.TOPIC_WORDS}') THEN 'mixed' WHEN regexp_matches(text, '{tx.FACT_WORDS}') THEN 'fact' ELSE 'topic' END AS type FROM documents")
def query_class(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", tx.classify_query("text")["type"].alias("type"))


_EXACT = "list_concat(list_concat(regexp_extract_all(text, '{0}'), regexp_extract_all(text, '{1}')), list_concat(list_transform(generate_series(1, len(regexp_extract_all(text, '{3}', 1))), lambda i: regexp_extract_all(text, '{3}', 1)[i] || regexp_extract_all(text, '{3}', 2)[i]), regexp_extract_all(text, '{2}')))".format(*tx.EXACT_PATTERNS, tx.UNIT_PATTERN)


@query(f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform({_EXACT}, lambda x: lower(x)))), '|'), '') AS vals FROM documents")
def exact_values(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tx.exact_values("text")), "|").alias("vals"))


_VALUES = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'v1.' || event_id || '.0' WHEN 2 THEN 'src/' || event_id || '.json' WHEN 3 THEN event_id || ' MB' WHEN 4 THEN 'mode=' || event_type WHEN 5 THEN '启用' || event_id WHEN 6 THEN 'C:' || chr(92) || event_type ELSE event_type END AS v, CASE WHEN event_id % 16 = 7 THEN '状态' ELSE 'p' END AS p FROM events"


@query(
    f"""SELECT event_id, CASE WHEN regexp_matches(v, '^\\d{{4}}[-/年]\\d{{1,2}}([-/月]\\d{{1,2}})?日?') THEN '日期' WHEN regexp_matches(v, '(?i)^v?\\d+\\.\\d+(\\.\\d+)?([-+][\\w.]+)?$') THEN '版本'
WHEN regexp_matches(v, '^[A-Za-z]:[\\\\/]') OR regexp_matches(v, '(?i)\\.(mjs|js|json|md|bat|ps1|db|zstd|yml|yaml)$') THEN '路径' WHEN regexp_matches(v, '(?i)^\\d+(\\.\\d+)?\\s*(个|条|轮|次|MB|GB|KB|秒|ms|字|页|行|项)?$') THEN '数量'
WHEN regexp_matches(v, '[=:：]') AND length(v) <= 40 THEN '配置' WHEN contains(p, '状态') OR regexp_matches(v, '^(开|关|启用|禁用|已|未|正常|异常|失败|成功)') THEN '状态' ELSE '实体' END AS category FROM ({_VALUES})"""
)
def value_category(spark, sf_dir):
    e, n = td.read(spark, sf_dir, "events"), F.col("event_id")
    s = n.cast("string")
    forms = [F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("v1."), s, F.lit(".0")), F.concat(F.lit("src/"), s, F.lit(".json")), F.concat(s, F.lit(" MB")), F.concat(F.lit("mode="), "event_type"), F.concat(F.lit("启用"), s), F.concat(F.lit("C:\\"), "event_type")]
    v = F.col("event_type")
    for k, form in enumerate(forms):
        v = F.when(n % 8 == k, form).otherwise(v)
    return e.select("event_id", tx.categorize(F.when(n % 16 == 7, "状态").otherwise("p"), v).alias("category"))


# ---- memory, facts, evidence, recall -------------------------------------------


@query(
    f"""WITH {td.ITEMS}, {_tokens_cte("SELECT id, concat_ws(' ', keywords, content) AS text FROM items")},
d AS (SELECT toks.id, updated_at, list_distinct(t) AS t FROM toks JOIN items ON items.id = toks.id), e AS (SELECT id, updated_at, len(t) AS n, unnest(t) AS k FROM d),
p AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND b.updated_at - a.updated_at >= {7 * td.DAY} GROUP BY 1, 2)
SELECT DISTINCT x AS id FROM p WHERE c * 1.0::DOUBLE / (na + nb - c) >= 0.45"""
)
def superseded_items(spark, sf_dir):
    return memory.superseded(td.items(spark, sf_dir))


@query(f"WITH {td.ITEMS} SELECT id, round(CASE WHEN level IN ('project', 'topic') THEN 0.5 + 0.5 * exp(-greatest(0, {td.NOW} - updated_at) / (30.0 * {td.DAY})) ELSE 1.0 END, 6) AS weight FROM items")
def recency_weight(spark, sf_dir):
    return td.items(spark, sf_dir).select("id", F.round(memory.recency_weight(F.col("level"), F.col("updated_at"), td.NOW, 30, 0.5, ("project", "topic")), 6).alias("weight"))


@query(f"WITH {td.ITEMS} SELECT id FROM items WHERE status <> 'archived' AND list_contains(list_transform(string_split(project, ','), lambda p: trim(p)), 'src3') AND NOT (updated_at <> 0 AND {td.NOW} - updated_at > 200::BIGINT * {td.DAY})")
def eligible_items(spark, sf_dir):
    own = td.items(spark, sf_dir).where("status <> 'archived'")
    return memory.eligible(own, td.NOW, "src3", 200).select("id")


def _facts(spark, sf_dir, *more) -> DataFrame:
    """Each event as a fact of a document about its day and its value."""
    e = td.read(spark, sf_dir, "events")
    src = F.col("user_id").cast("string")
    return e.select(src.alias("src"), F.lit("").alias("level"), F.lit("").alias("project"), F.lit(0).cast("long").alias("updated_at"), F.col("event_type").alias("subject"), F.lit("day").alias("predicate"), F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("v2."), F.col("event_id") % 9, F.lit(".1"))).alias("value"), F.lit("日期").alias("category"), (F.col("event_id") % 11).alias("src_updated_at"), *more)


@query(
    """WITH f AS (SELECT event_id, CAST(user_id AS VARCHAR) AS src, strftime(ts, '%Y-%m-%d') || 'v2.' || (event_id % 9) || '.1' AS v FROM events WHERE event_id % 11 = 4),
m AS (SELECT src, CAST(contains(v, 'v2.3.1') AS INTEGER) + CAST(contains(v, '2024-01-05') AS INTEGER) AS c FROM f),
g AS (SELECT src AS id, max(0.5 + least(1.0, 0.2 * c)) AS score, count(*) AS hits FROM m WHERE c > 0 GROUP BY src)
SELECT id, CAST(score AS DOUBLE) AS score, hits FROM g ORDER BY score DESC, hits DESC, id LIMIT 10"""
)
def facts_route(spark, sf_dir):
    f = _facts(spark, sf_dir)
    entries = f.select(F.col("src").alias("id"), F.lit(4).alias("updated_at")).distinct()
    asked = _question(spark, "What was V2.3.1 on 2024-01-05?")
    return facts.facts_route(asked, f, entries).select("id", "score", "hits")


@query(
    """WITH u AS (SELECT user_id, max(ts) AS now FROM events GROUP BY 1),
f AS (SELECT CAST(user_id AS VARCHAR) AS src, strftime(ts, '%Y-%m-%d') || 'v2.' || (event_id % 9) || '.1' AS v FROM events LEFT JOIN u USING (user_id) WHERE now IS NULL OR ts IS NULL OR NOT (ts < TIMESTAMP '2024-01-03') OR ts = now),
m AS (SELECT src, CAST(contains(v, 'v2.3.1') AS INTEGER) + CAST(contains(v, '2024-01-05') AS INTEGER) AS c FROM f),
g AS (SELECT src AS id, max(0.5 + least(1.0, 0.2 * c)) AS score, count(*) AS hits FROM m WHERE c > 0 GROUP BY src)
SELECT id, CAST(score AS DOUBLE) AS score, hits FROM g ORDER BY score DESC, hits DESC, id LIMIT 10"""
)
def facts_of_entries(spark, sf_dir):
    """Facts hold their entry's time, its user's last event; those of the first two days were taken when they happened, before the entry changed."""
    e = td.read(spark, sf_dir, "events")
    latest = e.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("ts").alias("updated_at"))
    each = _facts(spark, sf_dir, F.col("ts")).join(latest.withColumnRenamed("updated_at", "now"), F.col("src") == F.col("id"), "left")
    f = each.withColumn("src_updated_at", F.when(F.col("ts") < F.lit("2024-01-03").cast(e.schema["ts"].dataType), F.col("ts")).otherwise(F.col("now"))).drop("id", "now", "ts")
    asked = _question(spark, "What was V2.3.1 on 2024-01-05?")
    return facts.facts_route(asked, f, latest).select("id", "score", "hits")


@query(
    f"""WITH {td.ITEMS}, own AS (SELECT * FROM items WHERE coalesce(status, 'active') <> 'archived'), {_tokens_cte("SELECT id, concat_ws(' ', content, keywords) AS text FROM own")}, {_POST}, {_bm25_sql(_Q1)},
rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM sc)
SELECT id, level, project, round(score, 6) AS base, round(score, 6) AS score FROM rk JOIN own USING (id) WHERE rank < 5"""
)
def memory_search_bm25(spark, sf_dir):
    own = td.items(spark, sf_dir).where("coalesce(status, 'active') <> 'archived'")
    return memory.search(own, _QUESTION, td.NOW, memory.Options(mode="bm25"), index=_items_index(spark, sf_dir)).select("id", "level", "project", "base", "score")


_ASKED = _QUESTION + " v2.3.1"
_SUPERSEDED = f"""WITH {_tokens_cte("SELECT id, concat_ws(' ', keywords, substr(content, 1, 200)) AS text FROM items WHERE id IN (SELECT id FROM merged)")},
d AS (SELECT toks.id, updated_at, list_distinct(t) AS t FROM toks JOIN items ON items.id = toks.id), e AS (SELECT id, updated_at, len(t) AS n, unnest(t) AS k FROM d),
p AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND b.updated_at - a.updated_at >= {7 * td.DAY} GROUP BY 1, 2)
SELECT DISTINCT x AS id FROM p WHERE c * 1.0::DOUBLE / (na + nb - c) >= 0.45"""


def _memory_sql() -> str:
    steps = []
    for i in range(1, 21):
        steps.append(f"q{i} AS MATERIALIZED (SELECT p.id, p.t, 0.15 * p.t + 0.85 * coalesce(g.got, 0) + 0.85 * p.t * (SELECT coalesce(sum(rank), 0) FROM q{i - 1} WHERE id NOT IN (SELECT src FROM share)) AS rank FROM q{i - 1} p LEFT JOIN (SELECT dst, sum(rank * s) AS got FROM share JOIN q{i - 1} ON id = src GROUP BY dst) g ON g.dst = p.id)")
    return f"""WITH {td.ITEMS.replace("FROM documents)", "FROM documents), own AS (SELECT * FROM items WHERE coalesce(status, 'active') <> 'archived')")}, {_tokens_cte("SELECT id, concat_ws(' ', content, keywords) AS text FROM own")}, {_POST},
qs AS (SELECT 0 AS query_id, unnest(list_distinct({_tokens(f"'{_ASKED}'")})) AS term), {_bm25_sql("SELECT * FROM qs")},
{_PAIRS}, arcs AS (SELECT a AS src, b AS dst, w FROM edges UNION ALL SELECT b, a, w FROM edges), share AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM arcs),
vr AS (SELECT own.id, coalesce(list_dot_product(v.e, (SELECT e FROM v WHERE id = 0)) / (v.n * (SELECT n FROM v WHERE id = 0) + 1e-9), 0) AS score FROM own LEFT JOIN v USING (id)),
ranks AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM vr UNION ALL SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 FROM sc),
rrf AS (SELECT id, sum(1.0::DOUBLE / (61 + rank)) AS base FROM ranks WHERE rank < 50 GROUP BY id),
fs AS (SELECT user_id AS src, CAST(contains(strftime(ts, '%Y-%m-%d') || 'v2.' || (event_id % 9) || '.1', 'v2.3.1') AS INTEGER) AS c FROM events),
fr AS (SELECT src AS id, max(0.5 + least(1.0, 0.2 * c)) AS score, count(*) AS hits FROM fs WHERE c > 0 GROUP BY src ORDER BY score DESC, hits DESC, id LIMIT 10),
fb AS (SELECT id, 0.005 + least(1.5, CAST(score AS DOUBLE)) * 0.01 AS facts FROM fr WHERE id IN (SELECT id FROM own)),
sd AS (SELECT id, greatest(0.01, CASE WHEN score <> 0 THEN score ELSE 0.5 END) AS weight FROM (SELECT * FROM vr ORDER BY score DESC, id LIMIT 8)),
tele AS (SELECT id, weight / (SELECT sum(weight) FROM sd WHERE id IN (SELECT id FROM v)) AS t FROM sd WHERE id IN (SELECT id FROM v)),
q0 AS MATERIALIZED (SELECT v.id, coalesce(t, 0) AS t, coalesce(t, 0) AS rank FROM v LEFT JOIN tele USING (id)), {", ".join(steps)},
tp AS (SELECT id, rank, max(rank) OVER () AS most FROM (SELECT id, rank FROM q20 WHERE id IN (SELECT id FROM own) ORDER BY rank DESC, id LIMIT 20)),
pb AS (SELECT id, least(1.0, rank / most) * 0.01 AS ppr FROM tp WHERE most > 0 AND rank / most >= 0.1),
merged AS (SELECT coalesce(rrf.id, fb.id, pb.id) AS id, coalesce(base, 0) AS base, coalesce(facts, 0) AS facts, coalesce(ppr, 0) AS ppr FROM rrf FULL JOIN fb ON rrf.id = fb.id FULL JOIN pb ON coalesce(rrf.id, fb.id) = pb.id),
gone AS ({_SUPERSEDED}),
w AS (SELECT m.*, own.level, own.project, own.updated_at, CASE WHEN own.level IN ('project', 'topic') THEN 0.5 + 0.5 * exp(-greatest(0, {td.NOW} - own.updated_at) / (30.0 * {td.DAY})) ELSE 1.0 END AS weight, gone.id IS NOT NULL AS superseded FROM merged m JOIN own ON own.id = m.id LEFT JOIN gone ON gone.id = m.id)
SELECT id, level, project, updated_at, round(base, 6) AS base, round(facts, 6) AS facts, round(ppr, 6) AS ppr, round(weight, 6) AS weight, superseded, round(base + facts + ppr, 6) AS relevance, round((base + facts + ppr) * weight, 6) AS score
FROM w ORDER BY superseded, (base + facts + ppr) * weight DESC, id LIMIT 10"""


@query(_memory_sql())
def memory_search(spark, sf_dir):
    own = td.items(spark, sf_dir).where("coalesce(status, 'active') <> 'archived'")
    vs = td.vectors(spark, sf_dir)
    q = vs.where("id = 0").first()["vector"]
    nodes, edges = _graph(spark, sf_dir)
    # Facts were taken from the items as they are now.
    times = own.select(F.col("id").alias("src"), F.col("updated_at").alias("src_updated_at"))
    known = _facts(spark, sf_dir).withColumn("src", F.col("src").cast("long")).drop("src_updated_at").join(times, "src", "left")
    return memory.search(own, _ASKED, td.NOW, memory.Options(k=10, recency_days=30), vectors=vs, query_vector=q, facts=known, nodes=nodes, edges=edges)


_CHAIN = f"""{td.TURNS}, ws AS (SELECT session, user_seq, regexp_extract_all(lower(user_text), '[a-z]{{4,}}') AS w FROM turns),
ds AS (SELECT session, user_seq, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM ws),
chain AS (SELECT session, user_seq, unnest(list_transform(generate_series(1, len(d) - 1), lambda i: {{'s': d[i], 'o': d[i + 1], 'n': i - 1}})) AS t FROM ds WHERE len(d) > 1)"""


@query(f"WITH {_CHAIN} SELECT DISTINCT least(t.s, t.o) AS term_a, greatest(t.s, t.o) AS term_b FROM chain WHERE t.s <> t.o")
def term_graph_edges(spark, sf_dir):
    terms, flat = (table(x, "terms") for x in td.triples(spark, sf_dir))
    edges, _ = graph.term_graph(flat)
    names = terms.select("id", "normalized")
    named = edges.join(names.select(F.col("id").alias("a"), F.col("normalized").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("normalized").alias("y")), "b")
    return named.select(F.least("x", "y").alias("term_a"), F.greatest("x", "y").alias("term_b"))


@query("SELECT item_id, count(DISTINCT w) AS terms FROM benchmark JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM conversations) ON contains(lower(text), w) GROUP BY item_id")
def contains_terms(spark, sf_dir):
    words = td.read(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()
    texts = td.read(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("text"))
    found = lexical.words_within(texts, words, id_col="item_id", word_col="w")
    return found.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("terms"))


@query()
def turn_recall(spark, sf_dir):
    turns = table(td.turns(spark, sf_dir), "turns")
    terms, flat = (table(x, "terms") for x in td.triples(spark, sf_dir))
    found = recall.recall(recall.Store(turns, postings=table(recall.build_postings(turns), "postings"), terms=terms, triples=flat), _QUESTION)
    return found.select("session_id", "turn_index", "position", "score", "score_kind")


@query()
def recall_packed(spark, sf_dir):
    found = recall.recall(recall.Store(table(td.turns(spark, sf_dir), "turns")), _QUESTION).withColumn("query_id", F.lit(0))
    return injection.assemble(found).select("session_id", "turn_index", "included", "number", "block")


@query(
    f"""WITH {td.TURNS}, i AS (SELECT DISTINCT conv_id FROM conversations), g AS (SELECT session, t AS abs, user_seq FROM ends JOIN log l USING (session) WHERE l.seq = user_seq AND trim(l.text) <> ''),
a AS (SELECT conv_id, unnest(CASE WHEN conv_id % 3 = 0 THEN [1] ELSE [1, 2, 3] END) AS abs FROM i)
SELECT a.conv_id AS id, CAST(a.abs AS INTEGER) AS abs, g.user_seq FROM a JOIN g ON g.session = CAST(a.conv_id AS VARCHAR) AND g.abs = a.abs"""
)
def evidence_turns(spark, sf_dir):
    items = td.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    c = F.col("id")
    name = td.session_name(c.cast("string"))
    edits = items.select("id", F.when(c % 3 == 0, F.concat(F.lit("jot-update-"), name, F.lit("-turn(1)"))).otherwise(F.concat(F.lit("dream-update-"), name, F.lit("-turnRange(1,4); bad"))).alias("edit_history"))
    events = td.log(spark, sf_dir).withColumn("session", F.concat(F.lit("session-"), td.session_name(F.col("session"))))
    starts = events.where(sessions.real_user()).withColumns({"type": F.lit("turn/start"), "seq": F.col("seq").cast("double") - 0.5})
    groups = sessions.groups(events.withColumn("seq", F.col("seq").cast("double")).unionByName(starts))
    return evidence.locate(edits, groups).select("id", "abs", F.col("user_seq").cast("long").alias("user_seq"))
