import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, as_they_are=False):
    """Nodes by a dictionary of all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0, digest), role, text))
    whole = {}
    for c, turns in own.items():
        mine = [(r, t) for _, r, t in sorted(turns)]
        h = zlib.crc32(str(c).encode()) % 6
        group = [(r, t) for _, r, t in sorted(own.get(c - c % 100, []))]
        whole[c] = tuple(mine) if as_they_are else tuple(group[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(seed, n, words=3):
    """Conversations over few words, so that they share much; copies, and some that hold others."""
    draw = random.Random(seed)
    rows, before = [], []
    for c in range(n):
        turns = [("user" if k % 2 else None, draw.choice(["a", "bb", "ç€", None][:words])) for k in range(draw.choice([0, 1, 2, 3, 9]))]
        if before and draw.random() < 0.4:
            turns = draw.choice(before) + turns[: draw.choice([0, 0, 1])]
        before.append(turns)
        rows += [(c * 7 - 50, k, r, t) for k, (r, t) in enumerate(turns)] or [(c * 7 - 50, None, None, None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 2, 5, 17])
def test_nodes_are_those_of_all_prefixes_however_many_partitions(spark, parts):
    rows = made(parts, 70)
    turns = trie.turns_of(spark.createDataFrame(rows, _SCHEMA))
    assert found(trie.nodes(trie.rebuilt(turns), parts=parts)) == brute(rows)
    assert found(trie.nodes(trie.plain(turns), parts=parts)) == brute(rows, as_they_are=True)


def test_borders_anywhere_give_the_same_nodes():
    """Every way of cutting a short sorted run, without Spark's ranges."""
    draw = random.Random(5)
    for _ in range(60):
        rows = sorted((b"".join(bytes([draw.randrange(2)]) * trie.CODE for _ in range(draw.choice([0, 1, 2, 3, 6]))), c) for c in range(8))
        one = _by_cuts(rows, [])
        for at in range(1, 8):
            assert _by_cuts(rows, [at]) == one
            assert _by_cuts(rows, sorted({at, draw.randrange(1, 8), draw.randrange(1, 8)})) == one
        assert _by_cuts(rows, list(range(1, 8))) == one


def _by_cuts(rows, cuts):
    bounds = [0, *cuts, len(rows)]
    runs = [rows[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    lcps = [-1, *[trie.common(x[-1][0], y[0][0]) for x, y in zip(runs, runs[1:], strict=False)], -1]
    swept = []
    for k, run in enumerate(runs):
        sweep = trie.Sweep(k, lcps[k], lcps[k + 1])
        for seq, conv in run:
            swept += sweep.add(conv, seq, [1 + seq[16 * i] for i in range(len(seq) // 16)])
        swept += sweep.close()
    sums, ids = {}, defaultdict(list)
    for row in swept:
        if row[0] == "part":
            had = sums.get(row[1])
            sums[row[1]] = [row[2], row[7], *(f(a, b) for f, a, b in zip([min] + [lambda a, b: a + b] * 4, had[2:], (row[6], *row[9:13]), strict=True))] if had else [row[2], row[7], row[6], *row[9:13]]
        elif row[0] == "ids":
            ids[row[1]].append((row[3], row[4], row[5]))
    out = [row[6:] for row in swept if row[0] == "node"]
    out += [(row[6], row[7], sums[row[2]][2], *row[9:]) for row in swept if row[0] == "child"]
    for key, (parent, depth, least, *rest) in sums.items():
        ends = hashlib.sha256(b",".join(x[2] for x in sorted(ids[key]))).hexdigest()
        out.append((least, depth, sums[parent][2] if parent else None, *rest, ends))
    return sorted(out, key=str)


def test_copies_that_fill_several_partitions_are_one_node(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(600) for k in range(3)] + [(1000 + c, 0, "user", f"own {c}") for c in range(50)]
    turns = trie.turns_of(spark.createDataFrame(rows, _SCHEMA))
    assert found(trie.nodes(trie.plain(turns), parts=9)) == brute(rows, as_they_are=True)


def test_long_conversations_odd_rows_and_other_columns(spark):
    long = [(300, k, "user", "x" * (k % 7)) for k in range(3000)] + [(301, k, "user", "x" * (k % 7)) for k in range(2990)]
    rows = long + [(302, 1, "a", "b"), (302, 1, "a", "b"), (302, None, "z", None), (302, None, None, "z"), (None, 0, "user", "nobody"), (303, 0, "ab", "c"), (304, 0, "a", "bc")]
    df = spark.createDataFrame(rows, _SCHEMA).withColumns({"seq": F.lit(None).cast("string"), "part": F.lit(1), "chars": F.lit("x")})
    turns = trie.turns_of(df)
    assert found(trie.nodes(trie.rebuilt(turns), parts=3)) == brute(rows)
    assert found(trie.nodes(trie.rebuilt(trie.turns_of(df.where("conv_id > 999"))))) == []


def test_the_query_reads_whole_conversations(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.op13_conversation_prefix_trie(spark, path)) == brute(rows)
