"""What shows on larger tables only: long numbers, ties, crowded keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import graph, lexical, vectors


@pytest.fixture(scope="module")
def long_numbers(spark, tmp_path_factory):
    """Conversations of four and of five figures that begin alike."""
    path = tmp_path_factory.mktemp("long")
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"said {c} {t}") for c in (1, 9, 1000, 10000, 10009) for t in range(c % 3, 6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    docs = spark.createDataFrame([(c, "t", "en", "src1", 1) for c in (1, 2, 1000, 10000, 10009)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["memory_evidence", "refreshed_alignment", "latest_evidence", "evidence_turns", "wanted_sessions"])
def test_sessions_of_long_numbers(spark, long_numbers, name):
    import duckdb

    held = duckdb.connect()
    for t in ("conversations", "documents"):
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{long_numbers}/{t}.parquet/*.parquet'")
    want = sorted(held.execute(entry.oracle_sql()[name]).fetchall(), key=str)
    assert sorted(map(tuple, entry.queries()[name](spark, long_numbers).collect()), key=str) == want


def test_scores_that_differ_by_the_order_of_a_sum_go_by_id(spark):
    sums = spark.createDataFrame([("b", 0.1 + 0.2 + 0.3), ("a", 0.3 + 0.2 + 0.1), ("c", 0.5)], "id string, score double")
    assert 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1
    assert [r["id"] for r in sums.orderBy(F.desc(graph._level("score")), "id").collect()] == ["a", "b", "c"]


def test_cells_of_vectors_give_each_its_nearest_and_copy_blocks_by_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 4)).round(1)
    x[40:50] = x[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    blocks = vectors._blocks(df.coalesce(1), 2)
    unit = x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)
    s = unit @ unit.T
    assert blocks.count() == 45
    cells = vectors._met(blocks).groupBy("i", "j").count().collect()
    assert len(cells) == 21 and sum(r["count"] for r in cells) == 45 * 6
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors, "_blocks", lambda df, size=7, own=vectors._blocks: own(df, size))
        got = {(r["src"], r["dst"]) for r in vectors.similar_pairs(df, 0.3, 3).collect()}
        asked = df.where("id % 9 = 0").withColumnRenamed("id", "query_id")
        top = {(r["query_id"], r["rank"]): r["id"] for r in vectors.top_similar(df, asked, 4).collect()}
    for k in range(90):
        near = sorted((-s[k, j].round(9), j) for j in range(90) if j != k and s[k, j] >= 0.3)[:3]
        assert sorted(-s[k, j].round(9) for i, j in got if i == k) == [w for w, _ in near]
    for q in range(0, 90, 9):
        assert [s[q, top[q, r]].round(9) for r in range(4)] == sorted(s[q].round(9), reverse=True)[:4]


def test_best_of_each_is_the_head_of_the_whole_ranking(spark):
    r = random.Random(3)
    docs = [(f"d{k:03}", " ".join(r.choices("abcdefghij", [2**-i for i in range(10)], k=r.randint(1, 9)))) for k in range(300)] + [(f"e{k}", "a a b") for k in range(20)]
    held = lexical.postings(spark.createDataFrame(docs, "id string, text string"), tokens=F.split("text", " "))
    stats = lexical.corpus_stats(spark.createDataFrame(docs, "id string, text string"), tokens=F.split("text", " "))
    terms = spark.createDataFrame([(q, t) for q, own in ((1, "ab"), (2, "cdj"), (7, "zj"), (9, "z")) for t in own], "query_id long, term string")
    with pytest.MonkeyPatch.context() as patch:
        for name, value in (("_GRID", 64), ("_QUERIES", 2), ("_BLOCK_POSTINGS", 50)):
            patch.setattr(lexical, name, value)
        best = lexical.bm25_best(held, stats, terms, 6).collect()
    plain = [r.asDict() for r in lexical.bm25(held, stats, terms).collect()]
    blocks = 0
    for q in (1, 2, 7, 9):
        want = sorted((-round(p["score"], 9), p["doc"]) for p in plain if p["query_id"] == q)
        got = sorted((b["rank"], b["doc"], b["n"]) for b in best if b["query_id"] == q)
        assert got == [(k, d, len(want)) for k, (_, d) in enumerate(want[:6])]
        blocks += len(got)
    assert blocks == len(best) > 12


def test_documents_share_files(spark, tmp_path, monkeypatch):
    from lodestone.plans import catalogue_sources

    rows = [(u, t, k) for u in range(600) for k, t in enumerate(("view", "click", "view"))]
    spark.createDataFrame(rows, "user_id long, event_type string, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalogue_sources, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
    got = {(r["user_id"], r["event_type"]): r["n"] for r in entry.queries()["documents_read"](spark, str(tmp_path)).collect()}
    assert got == {(u, t): n for u in range(600) for t, n in (("view", 2), ("click", 1))}
    assert len(list(tmp_path.glob("documents/part=*/*.txt"))) == 3


def test_superseded_items_come_once_a_cell_and_are_brute_force(spark, monkeypatch):
    """Copies of one text are as many pairs as their square, of which a cell gives none but its items."""
    from lodestone.plans import memory

    monkeypatch.setattr(memory, "SET_BLOCK", 64)
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.sample(words, r.randrange(1, 25))) for _ in range(120)]
    rows = []
    for k in range(500):
        ws = r.choice(texts).split() if k >= 200 else texts[0].split()
        ws = [w if r.random() > 0.15 * (k % 3) else r.choice(words) for w in ws]
        rows.append((f"i{k}", " ".join(ws), "", r.choice([0, None] + list(range(1, 40))) if k % 50 == 7 else 1 + k % 40))
    day = memory.DAY_MS
    frame = spark.createDataFrame([(i, t, kw, None if d is None else d * day) for i, t, kw, d in rows], "id string, content string, keywords string, updated_at long")
    want, sets = set(), [(i, set(t[:200].split()), d) for i, t, _, d in rows if d]
    for i, a, s in sets:
        if any(u - s >= 7 and len(a & b) / len(a | b) >= 0.45 for _, b, u in sets):
            want.add(i)
    assert sorted(x["id"] for x in memory.superseded(frame).collect()) == sorted(want) and 0 < len(want) < 490

    near = memory._resembled

    def counted(gap, likeness):
        run = near(gap, likeness)

        def older(cell):
            found = run(cell)
            held = sum(len(x) for x in cell.column("ids").to_pylist())
            assert found.num_rows <= held, "more rows than items"
            return found

        return older

    monkeypatch.setattr(memory, "_resembled", counted)
    assert memory.superseded(frame).count() == len(want)


def test_blocks_of_vectors_are_copied_once_a_group_and_groups_are_bounded_in_bytes(spark):
    blocks = lambda dim, n: spark.range(n).select(F.lit(dim).cast("int").alias("dim"), F.array("id").alias("ids"), F.encode(F.lit("x"), "utf-8").alias("vectors"))
    # 300 blocks were 19 groups of 16, so 19 copies of each.
    assert vectors._met(blocks(64, 300)).count() == 300 * vectors.SPREAD
    wide = vectors._grouped(blocks(4096, 300), vectors.GROUP)[0].groupBy("g").count()
    assert max(r["count"] for r in wide.collect()) * 4096 * 8 * vectors.BLOCK <= vectors.GROUP_BYTES
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id long, vector array<float>")
    assert {len(bytes(r["vectors"])) // len(r["ids"]) for r in vectors._blocks(vectors._numbers(rows, "id", "vector")).collect()} == {2 * 4}


def test_nearest_of_few_and_of_many_above_the_least_agree_with_sorting():
    rng = np.random.default_rng(5)
    a, b = np.arange(40), np.arange(20, 320)
    s = rng.integers(0, 50, (len(a), len(b))) / 50.0
    for least in (-np.inf, 0.0, 0.5, 0.96):
        got = list(zip(*(x.tolist() for x in vectors._nearest(a, b, s.copy(), least, 3))))
        wanted = []
        for i, src in enumerate(a):
            near = sorted((-s[i, j], dst) for j, dst in enumerate(b) if src != dst and s[i, j] >= least)[:3]
            wanted += [(int(src), int(dst), float(-w)) for w, dst in near]
        assert got == wanted


def test_superseded_items_are_told_by_whole_texts(spark, monkeypatch):
    """Texts of one beginning that go apart, and ones that meet after it; sets of a few and of thousands of tokens."""
    from lodestone.plans import memory

    monkeypatch.setattr(memory, "SET_TOKENS", 5000)
    r, day = random.Random(8), memory.DAY_MS
    head = " ".join(f"h{k}" for k in range(60))
    rest = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    texts = [f"{head} {rest(f'own{k}', 300)}" for k in range(20)] + [f"{rest(f'other{k}', 60)} {rest('same', 300)}" for k in range(20)] + [rest("few", k) for k in range(1, 30)]
    texts += [rest("long", n) for n in (900, 2100, 2600, 4000)] + [" ".join(r.sample([f"z{k}" for k in range(500)], r.randrange(200, 480))) for _ in range(60)]
    rows = [(k, t, "", (1 + r.randrange(40)) * day) for k, t in enumerate(texts)]
    sets = [(k, set(t.split()), at) for k, t, _, at in rows]
    want = sorted(k for k, a, at in sets if any(u - at >= 7 * day and len(a & b) / len(a | b) >= 0.45 for _, b, u in sets))
    frame = spark.createDataFrame(rows, "id long, content string, keywords string, updated_at long")
    assert sorted(x["id"] for x in memory.superseded(frame).collect()) == want and not any(k < 20 for k in want) and any(20 <= k < 40 for k in want)
    assert any(k < 20 for k in (x["id"] for x in memory.superseded(frame, chars=200).collect()))


def test_titles_share_files(spark, tmp_path, monkeypatch):
    from lodestone.plans import catalogue_sources
    from lodestone.sources import tables

    rows = [(u, t, k) for u in range(600) for k, t in enumerate(("view", "click", "view"))]
    spark.createDataFrame(rows, "user_id long, event_type string, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalogue_sources, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
    got = sorted(tuple(r) for r in entry.queries()["session_titles"](spark, str(tmp_path)).collect())
    assert got == [(u, f"title {u}", "said view click view") for u in range(600)]
    assert len(list(tmp_path.glob("titles/part=*/*.txt"))) == 3
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "s7.json").write_text('{"record": {"rows": {\n"title": {"val": "t"}}}}')
    alone = tables.session_titles(spark, str(tmp_path / "own")).collect()
    assert [(r["path"].endswith("s7.json"), r["sid"], r["title"]) for r in alone] == [(True, None, "t")]
