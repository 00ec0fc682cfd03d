"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton of all items is built once and sent to the executors; documents
stream through it word by word. At each word it gives the longest run of words
that ends there and occurs in an item. A run of ``window`` words, or a whole item
of fewer, is a hit; hit words are removed, and a document with too large a share
of hit words is dropped.

Defined results: a null or empty text has no words and no hits; items without words
match nothing; items that share an id count once, those of a null id too: they count in ``n_items``, and
``items_sha256`` passes over them; repeated documents are scanned
one by one; ties don't arise. Extra columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import by_batch, session, table, text_bytes

WINDOW = 10
#: Words of items in one automaton, and automata that one pass over the documents takes; a larger benchmark takes several passes.
BLOCK_WORDS, PASS = 250_000, 4
#: Words that one lane of a scan goes through after its warm-up.
LANE = 64


class _States:
    """A generalised suffix automaton while it is built, word by word."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.len[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1


def _lists(pairs: set[tuple[int, int]], states: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): the values of state v are values[first[v]:first[v + 1]]."""
    own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(own[:, 0], np.arange(states + 1)).astype(np.int32), own[:, 1].astype(np.int32)


def _spread(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``at``, index into the values) of all values of the states ``at``."""
    n = first[at + 1] - first[at]
    source = np.repeat(np.arange(len(at)), n)
    return source, np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + first[at][source]


class Automaton:
    """A generalised suffix automaton over the word sequences of ``items``, [(item id, [word, ...]), ...], in flat arrays.

    A state stands for runs of words that end at the same places of the items. ``cover`` is, for a state, that of the last
    ``window`` words. ``short`` is the nearest state among a state and those its links lead to that ends items of fewer
    words; ``ends`` are the groups of such items, equal ones being a group. ``holders`` are the items of each group, and before
    these of each state's window.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        items = [(i, w) for i, w in items if w]
        self.items = [i for i, _ in items]
        self.vocabulary = sorted({w for _, ws in items for w in ws})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        sequences = [[number[w] for w in ws] for _, ws in items]
        states = _States()
        for ws in sequences:
            last = 0
            for w in ws:
                last = states.extend(last, w)
        self._flatten(states)
        holders, groups = set(), {}
        for item, ws in enumerate(sequences):
            v = 0
            for k, w in enumerate(ws):
                v = states.next[v][w]
                if k + 1 >= window:
                    holders.add((int(self.cover[v]), item))
            if len(ws) < window:
                while self.length[self.link[v]] >= len(ws):
                    v = int(self.link[v])
                holders.add((len(self.link) + groups.setdefault((v, len(ws)), len(groups)), item))
        self.sizes = np.array([n for _, n in groups], np.int64)
        self.holders = _lists(holders, len(self.link) + len(groups))
        self.ends = _lists({(v, k) for k, (v, _) in enumerate(groups)}, len(self.link))
        self.short = np.zeros(len(self.link), np.int32)
        if groups:
            full = (self.ends[0][1:] > self.ends[0][:-1]).tolist()
            short, link = self.short.tolist(), self.link.tolist()
            for v in np.argsort(self.length, kind="stable")[1:].tolist():
                short[v] = v if full[v] else short[link[v]]
            self.short = np.array(short, np.int32)
        self.least = min([window] * (len(groups) < len(holders)) + self.sizes.tolist(), default=window)
        self._vocabulary_table()

    def _flatten(self, states: _States) -> None:
        n, words = len(states.len), max(1, len(self.vocabulary))
        self.link = np.maximum(np.array(states.link, np.int32), 0)
        self.length = np.array(states.len, np.int32)
        keys = np.fromiter((v * words + w for v, own in enumerate(states.next) if v for w in own), np.int64)
        targets = np.fromiter((to for v, own in enumerate(states.next) if v for to in own.values()), np.int32)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], targets[order]
        self.root = np.array([states.next[0][w] for w in range(len(self.vocabulary))], np.int32)
        # Links lead to shorter states, so these are filled in order of length.
        cover, link, length = list(range(n)), self.link.tolist(), self.length.tolist()
        for v in np.argsort(self.length, kind="stable").tolist():
            if length[link[v]] >= self.window:
                cover[v] = cover[link[v]]
        self.cover = np.array(cover, np.int32)

    def _vocabulary_table(self) -> None:
        found = np.array([tokens.word_hash(w) for w in self.vocabulary], np.uint64)
        order = np.argsort(found)
        self.hashes, self.numbers = found[order], order.astype(np.int32)
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words of the items have one hash")
        #: Most words aren't in any item; this table of hash prefixes says so at once.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def _step(self, v: np.ndarray, size: np.ndarray, w: np.ndarray) -> None:
        """Take each lane from state ``v`` and longest match ``size`` over its next word; -1 is a word of no item."""
        v[w < 0] = 0
        size[w < 0] = 0
        wait = np.flatnonzero(w >= 0)
        while len(wait):
            top = v[wait] == 0
            new = wait[top]
            v[new], size[new] = self.root[w[new]], 1
            wait = wait[~top]
            if not len(wait):
                break
            key = v[wait].astype(np.int64) * len(self.vocabulary) + w[wait]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            on = wait[there]
            v[on] = self.targets[at[there]]
            size[on] += 1
            wait = wait[~there]
            v[wait] = self.link[v[wait]]
            size[wait] = self.length[v[wait]]

    def _scan(self, begin: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last word, words, group) of the occurrences of windows and short items in runs of words.

        Runs are cut into lanes that are walked side by side. A lane warms up on the words that a window
        can begin with, so its matches are as long as they are, or as a window.
        """
        pieces = -(-(end - begin) // LANE)
        run = np.repeat(np.arange(len(begin)), pieces)
        at = begin[run] + LANE * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(at + LANE, end[run])
        start = np.maximum(at - self.window + 1, begin[run])
        order = np.argsort(start - stop, kind="stable")
        start, stop = start[order], stop[order]
        sizes = stop - start
        v, size = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        found = []
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t))  # lanes longer than t come first
            self._step(v[:n], size[:n], numbers[start[:n] + t])
            long = np.flatnonzero(size[:n] >= self.window)
            if len(long):
                found.append((start[long] + t, np.full(len(long), self.window), self.cover[v[long]]))
            if len(self.sizes):
                lane = np.flatnonzero(self.short[v[:n]] > 0)
                state = self.short[v[lane]]
                while len(lane):
                    source, k = _spread(self.ends[0], state)
                    group = self.ends[1][k]
                    fits = self.sizes[group] <= size[lane[source]]
                    found.append((start[lane[source]][fits] + t, self.sizes[group][fits], len(self.link) + group[fits]))
                    state = self.short[self.link[state]]
                    lane, state = lane[state > 0], state[state > 0]
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty)

    def hits(self, buf: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], found: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str | None]]]:
        """(whether each word is hit, distinct (text, item id)) for the words of consecutive texts, given their hashes."""
        starts, ends, first = words
        none = np.zeros(len(starts), bool)
        if not len(self.vocabulary) or not len(starts):
            return none, []
        known = self.maybe[found >> np.uint64(44)]
        # Runs of words that items may hold, within one text.
        edge = np.zeros(len(starts) + 1, bool)
        edge[first] = True
        begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate(([False], known[:-1]))))
        end = np.flatnonzero(known & (edge[1:] | ~np.concatenate((known[1:], [False])))) + 1
        enough = end - begin >= self.least
        begin, end = begin[enough], end[enough]
        if not len(begin):
            return none, []
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1) if len(begin) > len(found) // 64 else None
        numbers = np.full(len(starts), -1, np.int32)
        if at is None:
            inside = np.concatenate([np.arange(a, b) for a, b in zip(begin.tolist(), end.tolist())])
            at = np.minimum(np.searchsorted(self.hashes, found[inside]), len(self.hashes) - 1)
        else:
            inside = np.arange(len(found))
        numbers[inside] = np.where(self.hashes[at] == found[inside], self.numbers[at], -1)
        while True:
            last, size, group = self._scan(begin, end, numbers)
            change = np.bincount(last + 1 - size, minlength=len(starts) + 1)[: len(starts) + 1] - np.bincount(last + 1, minlength=len(starts) + 1)
            hit = np.cumsum(change[:-1]) > 0
            # A word is known by its hash; hit words are compared by their bytes.
            wrong = [k for k in np.flatnonzero(hit).tolist() if bytes(tokens.LOWER[buf[starts[k] : ends[k]]]) != self.vocabulary[numbers[k]]]
            if not wrong:
                break
            numbers[wrong] = -1
        groups = len(self.holders[0])
        once = np.unique((np.searchsorted(first, last, side="right") - 1) * groups + group)
        source, k = _spread(self.holders[0], once % groups)
        return hit, [(t, self.items[i]) for t, i in zip((once // groups)[source].tolist(), self.holders[1][k].tolist())]


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata that together hold all items; the driver has the items of one block at a time."""
    block, words = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), text_bytes(text_col).alias("t")).where("t IS NOT NULL").toLocalIterator():
        ws = tokens.words(bytes(row["t"]), tokens.ALNUM)
        if block and words + len(ws) > block_words:
            yield Automaton(block, window)
            block, words = [], 0
        block.append((row["i"], ws))
        words += len(ws)
    yield Automaton(block, window)


MATCH = T.StructType(
    [
        T.StructField("words", T.LongType()),
        T.StructField("hits", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("clean", T.BinaryType()),
    ]
)


def match(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, clean: bool = True) -> DataFrame:
    """``docs`` as struct ``doc``, and struct ``match``.

    ``words`` and ``hits`` count a text's words and its hit words; ``items`` has the ids of the items
    found; ``spans`` has first and last-but-one byte positions of the hit runs, flattened; ``clean`` is
    the text without them, null where nothing is hit.
    """
    spark = session(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"))
    found = automata(items, item_id, item_text, window, block_words)
    more = False
    while autos := list(islice(found, PASS)):
        if more:
            rows = table(rows, "matches")
        sent = spark.sparkContext.broadcast(autos)
        inputs = [F.col("doc")[text_col].cast("binary"), *([F.col("match")] if more else [])]
        rows = rows.select("doc", by_batch(_matcher(sent, clean), MATCH, *inputs).alias("match"))
        more = True
    return rows


def _matcher(sent, clean: bool):
    def run(texts: pa.Array, earlier: pa.Array | None = None) -> pa.Array:
        past = earlier.to_pylist() if earlier is not None else None
        out = []
        for _, _, buf, offsets in tokens.slices(texts):
            words = tokens.bounds(buf, offsets, tokens.ALNUM)
            starts, ends, first = words
            hashes = tokens.hashes(buf, starts, ends)
            hit, items = np.zeros(len(starts), bool), {}
            for auto in sent.value:
                own, pairs = auto.hits(buf, words, hashes)
                hit |= own
                for text, item in pairs:
                    items.setdefault(text, set()).add(item)
            for k, base in enumerate(offsets[:-1].tolist()):
                a, b = first[k], first[k + 1]
                before = past[len(out)] if past else None
                if before:
                    items.setdefault(k, set()).update(before["items"])
                    for x, y in zip(before["spans"][::2], before["spans"][1::2]):
                        hit[a:b] |= (starts[a:b] - base >= x) & (ends[a:b] - base <= y)
                out.append(_result(buf, offsets, int(b - a), starts[a:b], ends[a:b], hit[a:b], items.get(k, ()), clean, base))
        return pa.array(out, _TYPE)

    return run


_TYPE = pa.struct([("words", pa.int64()), ("hits", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64())), ("clean", pa.binary())])


def _result(buf, offsets, n, starts, ends, hit, items, clean, base) -> dict:
    hits = int(hit.sum())
    if not hits:
        return {"words": n, "hits": 0, "items": [], "spans": [], "clean": None}
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    a, b = starts[edge[:-1] == 1] - base, ends[edge[1:] == -1] - base
    spans = np.stack([a, b], 1).ravel().tolist()
    kept = None
    if clean:
        stop = int(offsets[np.searchsorted(offsets, base, side="right")]) if base < offsets[-1] else int(base)
        text, at, parts = bytes(buf[base:stop]), 0, []
        for x, y in zip(spans[::2], spans[1::2]):
            parts.append(text[at:x])
            at = y
        kept = b"".join([*parts, text[at:]])
    return {"words": n, "hits": hits, "items": sorted(items, key=lambda i: (i is None, i or "")), "spans": spans, "clean": kept}


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", most_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without the words that occur in test items.

    Every hit run is cut out of its text. A document of which more than ``most_coverage`` of the words
    are hit goes. All columns stay; texts without hits stay as they are.
    """
    found = match(docs, items, text_col=text_col, **options)
    kept = found.where(F.col("match.hits") <= most_coverage * F.col("match.words"))
    return kept.select(*[F.coalesce(F.col("match.clean").cast("string"), F.col("doc")[c]).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    m = F.col("match")
    return match(docs, items, clean=False).select(
        F.col("doc.doc_id").alias("doc_id"),
        m.words.alias("n_words"),
        m.hits.alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(m["items"]), ","), 256).alias("items_sha256"),
        (m.hits > 0).alias("contaminated"),
    )


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
g AS (SELECT item_id, least(len(ws), 10) AS n, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i, ws FROM b WHERE len(ws) > 0),
gw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM g),
sizes AS (SELECT DISTINCT n FROM gw),
p AS (SELECT rid, n, unnest(generate_series(1, len(ws) - n + 1)) AS i, ws FROM d, sizes WHERE len(ws) >= n),
pw AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM p),
h AS (SELECT rid, pw.n, i, item_id FROM pw JOIN gw ON pw.n = gw.n AND pw.w = gw.w),
hw AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
