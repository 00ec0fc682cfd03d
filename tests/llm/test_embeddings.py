import numpy as np
import pytest

from lodestone.llm import embeddings as E


def brute(rows, least):
    def unit(v):
        if v is None or len(v) != 8 or None in v:
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and np.linalg.norm(x) > 0 else None

    units, root = [unit(v) for _, v, _ in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = {}
    for k, (i, _, _) in enumerate(rows):
        smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted((i, links[k], smallest[find(k)]) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("seed,lists", [(1, None), (2, 12)])
def test_brute_force(spark, seed, lists):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(60):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 15)):
            rows.append((base + r.normal(size=8) * r.choice([0, 0.05, 0.12]), int(r.integers(0, 3))))
            if r.random() < 0.2:
                base = rows[-1][0]
    rows = [(k * 13 % 5003, v.astype(np.float32).tolist(), y) for k, (v, y) in enumerate(rows)]
    odd = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 5, []]
    rows += [(6000 + k, v, 1) for k, v in enumerate(odd)] + [(7000, rows[0][1], None), (7001, [1e-38] * 8, 0), (7002, [3e38] * 8, 0)]
    frame = spark.createDataFrame([(*x, 5) for x in rows], "vec_id long, embedding array<float>, label int, n int")
    got = E.near_vectors(frame, lists=lists)
    assert sorted(map(tuple, got.collect())) == brute(rows, 0.93)


def test_hot_list_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    monkeypatch.setattr(E, "ASK", 64)
    r = np.random.default_rng(4)
    base = r.normal(size=8)
    rows = [(k, (base + r.normal(size=8) * 0.13).astype(np.float32).tolist(), 1) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, E.near_vectors(frame, lists=3).collect())) == brute(rows, 0.93)


def test_each_length_is_linked(spark):
    """Lengths of fewer vectors too, and whatever the number of empty and unlabelled ones."""
    r = np.random.default_rng(8)
    rows = []
    for dim, n in ((8, 30), (3, 12), (5, 2), (6, 1)):
        base = r.normal(size=dim)
        rows += [(100 * dim + k, (base + r.normal(size=dim) * 0.2).astype(np.float32).tolist(), k % 2 if n > 2 else 0) for k in range(n)]
    rows += [(1000 + k, [], 1) for k in range(50)] + [(1100 + k, [1.0] * 4, None) for k in range(50)] + [(1200, None, 1)]
    want = []
    for dim in (8, 3, 5, 6):
        own = [x for x in rows if x[1] and x[2] is not None and len(x[1]) == dim]
        want += brute([(i, v + [0.0] * (8 - dim), y) for i, v, y in own], 0.93)
    want += [(i, 0, i) for i, v, y in rows if not v or y is None]
    assert sum(n > 0 for i, n, _ in want if i < 800) > 5
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, E.near_vectors(frame).collect())) == sorted(want)


def test_nothing_to_compare(spark):
    frame = spark.createDataFrame([(1, None, 1), (2, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, E.near_vectors(frame).collect())) == [(1, 0, 1), (2, 0, 2)]
    assert E.near_vectors(frame.limit(0)).count() == 0


def test_copies_repeated_ids_and_other_labels(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    rows = [(k, base.astype(np.float32).tolist(), "a") for k in range(200)] + [(300 + k, (2 * base + r.normal(size=8) * 0.1).astype(np.float32).tolist(), "ab"[k % 2]) for k in range(80)]
    rows += [(300, rows[-1][1], "b"), (300, rows[-1][1], "b"), (7, [-v for v in rows[0][1]], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(map(tuple, E.near_vectors(frame).collect()))
    # Ids of several rows: links are by row, the component by id.
    assert [(i, n) for i, n, _ in got] == [(i, n) for i, n, _ in brute(rows, 0.93)]
    assert {c for i, _, c in got if i in (0, 199, 302)} == {0} and {c for i, _, c in got if i == 301} == {300}
    assert got[-1][1] == sum(y == "b" for _, _, y in rows) - 1
    doubles = spark.createDataFrame([(i, [float(x) for x in v], y) for i, v, y in rows], "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, E.near_vectors(doubles).collect())) == got


def test_lists_are_pruned_and_recall_is_whole():
    """Random directions, which no list suits: units still ask a part of the lists only, and the codes rule out most pairs."""
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 64))
    x[1500:] = x[:1500] + r.normal(size=(1500, 64)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = E.Quantiser(x, 64)
    radius = np.sqrt(2 - 2 * 0.93)
    near, asks = q.asks(x, radius)
    links = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert len(links) > 1000
    assert (asks[links[:, 0], near[links[:, 1]]] | asks[links[:, 1], near[links[:, 0]]] | (near[links[:, 0]] == near[links[:, 1]])).all()
    assert asks.mean() < 0.3
    own = np.flatnonzero(near == 0)
    codes, errors = q.code(x[own], near[own])
    assert (q.distances(x, 0, codes) - errors <= radius).mean() < 0.05


def test_bounds_hold():
    """A code's error bounds how far its distance is off, and of two near vectors one asks the other's list."""
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = E.Quantiser(x, 10)
    near, asks = q.asks(x, 0.9)
    codes, errors = q.code(x, near)
    exact = np.linalg.norm(x[:, None] - x[None], axis=2)
    for c in range(10):
        own = np.flatnonzero(near == c)
        if len(own):
            assert (np.abs(q.distances(x, c, codes[own]) - exact[:, own]) <= errors[own] + 1e-9).all()
    a, b = np.nonzero((exact <= 0.9) & (near[:, None] != near[None]))
    assert len(a) and (asks[a, near[b]] | asks[b, near[a]]).all()
