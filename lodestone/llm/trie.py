"""The trie of all conversations' turns, by a global sort of turn arrays.

A conversation is the array of its turns; a turn is known by 128 bits of the SHA-256 of its role and text. Arrays are
range-sorted by (array, conversation), so that copies lie side by side and a group of them can span partitions. Adjacent
common prefixes (LCPs) then say all: a stack sweep of each partition folds its LCP intervals into nodes. The LCPs between
partitions are found first, from each partition's first and last array, so a sweep knows which of its stack's nodes
reach over its borders; of these it gives partial sums under the digest of the node's prefix, which meet in
one aggregate. No task holds more than one sorted partition, however large a subtree or a group of copies is.

Sums over a node's subtree come from its interval alone. Of a row, all turns up to its LCP with the row before are shared
with it; so the tokens saved below a node are, summed over its rows but the first, those from the node's own turn to the LCP.

Defined results: rows of a null conversation count for nothing; a null role or text is empty; a null turn comes first;
turns of one number go by their digests, and rows that repeat are turns of their own; a conversation that ends
up without turns is a member of the root alone; an empty table has no nodes; columns of other names are not read. Texts
count in code points, whole. One conversation's array (20 bytes a turn) is the unit that a task has to hold.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, input_partitions, table, tidy

#: Bytes of a turn's digest, and of turns that a sorted partition should hold.
CODE, PART_BYTES = 16, 8 << 20
#: Bytes of member ids in one row on their way to the hash of a node that spans partitions.
CHUNK = 1 << 16
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"kind string, key binary, parent_key binary, part long, chunk long, ids binary, {_NODE}"
_NAMES = [c.split()[0] for c in _SWEPT.split(", ")]
#: Unsigned crc32 of the decimal id, modulo this, turns of a conversation are those of its group's first.
GROUP, HEAD = 100, 6


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, code, chars) of every turn; the code's lengths keep roles and texts apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    code = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * CODE))
    rows = conversations.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), code.alias("code"), F.char_length(text).alias("chars"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, seq, chars): the first h turns of the group's first conversation, then its own turns after its first h."""
    base = F.col("conv") - F.col("conv") % GROUP
    # Dealt by group, so that a conversation's turns and its group's first meet without another exchange.
    dealt = turns.withColumn("base", base).repartition(input_partitions(turns), "base")
    held = dealt.groupBy("base", "conv").agg(F.sort_array(F.collect_list(F.struct("turn", "code", "chars"))).alias("own"))
    group = Window.partitionBy("base")
    held = held.withColumn("head", F.max(F.when(F.col("conv") == F.col("base"), F.slice("own", 1, HEAD - 1))).over(group))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0))
    held = held.select("conv", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("turns"))
    return held.select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["code"])), "")).alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def plain(turns: DataFrame) -> DataFrame:
    """(conv, seq, chars) of the conversations as they are."""
    held = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "code", "chars"))).alias("turns"))
    return held.select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["code"])), "")).alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two arrays share from their beginning."""
    lo, hi = 0, min(len(a), len(b)) // CODE
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * CODE : mid * CODE] == b[lo * CODE : mid * CODE]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def prefix_keys(seq: bytes, depths: range) -> list[bytes]:
    """Digests of a sequence's prefixes of the given depths, which are ascending."""
    out, running = [], hashlib.sha256(seq[: depths.start * CODE]) if depths else None
    for d in depths:
        if d > depths.start:
            running.update(seq[(d - 1) * CODE : d * CODE])
        out.append(struct.pack(">q", d) + running.digest()[:CODE])
    return out


class _Frame:
    """Nodes of the depths (the frame's below it, ``depth``], which all have the same rows of this partition."""

    __slots__ = ("depth", "n", "least", "leaves", "shared", "later", "children", "inner", "ids", "seq", "cum", "first", "pending")

    def __init__(self, depth: int, seq: bytes, cum: list[int], first: bool):
        self.depth, self.seq, self.cum, self.first = depth, seq, cum, first
        self.n = self.leaves = self.shared = self.later = self.children = 0
        self.least: int | None = None
        self.inner = False  # some row goes deeper
        self.ids: list[bytes] = []  # of members that end here
        self.pending: list[tuple] = []  # nodes right below, until this one's least member is known


class Sweep:
    """The stack of one sorted partition; ``before`` and ``after`` are its border LCPs, -1 where nothing lies beyond."""

    def __init__(self, part: int, before: int, after: int):
        self.part, self.before, self.after = part, before, after
        self.stack: list[_Frame] = []
        self.prev: bytes | None = None

    def add(self, conv: int, seq: bytes, chars: list[int]) -> Iterator[tuple]:
        cum = [0]
        for c in chars:
            cum.append(cum[-1] + c)
        depth, first = len(seq) // CODE, self.prev is None
        if first:
            lcp = max(self.before, 0)
            self.stack.append(_Frame(0, seq, cum, True))
            if lcp:
                self.stack[0].inner = True
                self.stack.append(_Frame(lcp, seq, cum, True))
            joins = self.before >= 0
        else:
            lcp, joins = common(self.prev, seq), True
            yield from self._down_to(lcp)
        top = self.stack[-1]
        if joins:
            top.shared += cum[lcp]
            top.later += 1
        if depth > lcp:
            top.children += 1
            top.inner = True
            top = _Frame(depth, seq, cum, first)
            self.stack.append(top)
        top.n += 1
        top.least = conv if top.least is None else min(conv, top.least)
        top.ids.append(b"%d" % conv)
        self.prev = seq

    def close(self) -> Iterator[tuple]:
        """What is still on the stack: whole nodes, then those that go on in the next partition."""
        if self.prev is None:
            return
        if self.after >= 0:
            yield from self._down_to(self.after)
        while self.stack:
            yield from self._pop(self.after >= 0)

    def _down_to(self, lcp: int) -> Iterator[tuple]:
        while self.stack[-1].depth > lcp:
            below = self.stack[-2]
            if below.depth < lcp:  # the interval parts here: what lies above is a node with one child so far
                top = self.stack[-1]
                split = _Frame(lcp, top.seq, top.cum, top.first)
                split.inner = True
                split.children = 0 if top.first and self.before > lcp else 1
                self.stack.insert(-1, split)
            yield from self._pop(False)

    def _pop(self, goes_on: bool) -> Iterator[tuple]:
        f = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        # The members' ids ascend only within equal rows, so the least of a subtree is kept beside them.
        if not f.inner and not goes_on:
            f.leaves += 1
        top = parent.depth + 1 if parent else 0
        came = f.first and f.depth <= self.before
        depths = range(top, f.depth + 1)
        saved = [f.shared - f.later * f.cum[d - 1] if d else f.shared for d in depths]
        if came or goes_on:
            yield from self._partial(f, depths, saved, came)
        else:
            yield from self._whole(f, parent, depths, saved)
        if parent:
            parent.n += f.n
            parent.least = f.least if parent.least is None else min(f.least, parent.least)
            parent.leaves += f.leaves
            parent.shared += f.shared
            parent.later += f.later

    def _whole(self, f: _Frame, parent: _Frame | None, depths: range, saved: list[int]) -> Iterator[tuple]:
        ends = hashlib.sha256(b",".join(f.ids)).hexdigest()
        none = hashlib.sha256(b"").hexdigest()
        rows = []
        for d, s in zip(depths, saved, strict=True):
            last = d == f.depth
            rows.append((f.least, d, f.least, f.n, f.children if last else 1, f.leaves, s, ends if last else none))
        for row in f.pending:
            yield ("node", None, None, None, None, None, row[0], row[1], f.least, *row[3:])
        for row in rows[1:]:
            yield ("node", None, None, None, None, None, *row)
        if parent:
            parent.pending.append(rows[0])
        else:
            conv, d, _, *rest = rows[0]
            yield ("node", None, None, None, None, None, conv, d, None, *rest)

    def _partial(self, f: _Frame, depths: range, saved: list[int], came: bool) -> Iterator[tuple]:
        """Sums of this partition's rows for nodes that lie in others as well, by the nodes' keys."""
        from_top = range(max(depths.start - 1, 0), depths.stop)
        keys = dict(zip(from_top, prefix_keys(f.seq, from_top), strict=True))
        for d, s in zip(depths, saved, strict=True):
            # A child that came with the first row was counted where it began.
            children = f.children if d == f.depth else int(not came)
            yield ("part", keys[d], keys.get(d - 1), None, None, None, f.least, d, None, f.n, children, f.leaves, s, None)
        at, size, held = 0, 0, []
        for k, one in enumerate(f.ids):
            held.append(one)
            size += len(one) + 1
            if size >= CHUNK or k == len(f.ids) - 1:
                yield ("ids", keys[f.depth], None, self.part, at, b",".join(held), None, f.depth, None, None, None, None, None, None)
                at, size, held = at + 1, 0, []
        for row in f.pending:
            yield ("child", None, keys[f.depth], None, None, None, row[0], row[1], None, *row[3:])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", ")])


def _swept(borders: dict[int, tuple[int, int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sweep = None
        for batch in batches:
            for part, conv, seq, chars in zip(*(batch.column(k) for k in range(4)), strict=True):
                part = part.as_py()
                if sweep is None or sweep.part != part:
                    if sweep:
                        yield from sweep.close()
                    sweep = Sweep(part, *borders[part])
                yield from sweep.add(conv.as_py(), seq.as_py(), chars.as_py())
        if sweep:
            yield from sweep.close()

    return tidy(lambda batches: _batches(rows(batches), _schema(_SWEPT)))


def _border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lcps = [common(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lcps, pa.int64())], names=["part", "lcp"])


def borders(runs: DataFrame) -> dict[int, tuple[int, int]]:
    """LCPs of each sorted partition with the ones before and after it: two numbers a partition are all that the driver gets."""
    ends = table(runs.groupBy("part").agg(F.min_by("seq", "at").alias("first"), F.max_by("seq", "at").alias("last")), "trie-ends")
    parts = sorted(r[0] for r in ends.select("part").collect())
    if not parts:
        return {}
    spark = runs.sparkSession
    follow = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "one long, part long")
    met = ends.select(F.col("part").alias("one"), "last").join(follow, "one").join(ends.select("part", "first"), "part").select("part", "last", "first")
    lcps = {r["part"]: r["lcp"] for r in met.mapInArrow(_border, "part long, lcp long").collect()}
    discard(ends)
    return {p: (lcps.get(p, -1), lcps[q] if (q := after) is not None else -1) for p, after in zip(parts, [*parts[1:], None], strict=True)}


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's chunks, which come in order; nothing but the hash's state is held."""
    schema = _schema("key binary, ends string")

    def rows() -> Iterator[tuple]:
        key, running = None, None
        for batch in batches:
            for k, ids in zip(batch.column(0), batch.column(1), strict=True):
                k = k.as_py()
                if k != key:
                    if key is not None:
                        yield key, running.hexdigest()
                    key, running = k, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_buffer())
        if key is not None:
            yield key, running.hexdigest()

    yield from _batches(rows(), schema)


def nodes(sequences: DataFrame, parts: int | None = None) -> DataFrame:
    """The trie's nodes of ``sequences`` (conv, seq, chars), a row each; ``parts`` is the number of sorted partitions."""
    held = table(sequences, "trie-turns")
    if parts is None:
        size = held.agg(F.sum(F.octet_length("seq") + 64)).first()[0] or 0
        parts = max(input_partitions(held), size // PART_BYTES + 1)
    runs = held.repartitionByRange(parts, "seq", "conv").sortWithinPartitions("seq", "conv")
    at = F.monotonically_increasing_id()
    runs = table(runs.select(at.alias("at"), F.shiftright(at, 33).alias("part"), "conv", "seq", "chars"), "trie-sorted")
    discard(held)
    dealt = runs.repartition(parts, "part").sortWithinPartitions("at").select("part", "conv", "seq", "chars")
    swept = table(dealt.mapInArrow(_swept(borders(runs)), _SWEPT), "trie-swept")
    discard(runs)

    # Nodes that span partitions: their sums, and the hash of the members that end there.
    partial = swept.where("kind = 'part'")
    sums = partial.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    chunks = swept.where("kind = 'ids'").repartition(input_partitions(swept), "key").sortWithinPartitions("key", "part", "chunk").select("key", "ids")
    ends = chunks.mapInArrow(_ends, "key binary, ends string")
    none = hashlib.sha256(b"").hexdigest()
    stitched = table(sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(none))).drop("ends"), "trie-stitched")

    # The least members of parents; a node whose parent spans partitions takes it from there.
    parent = stitched.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    names = _NAMES[6:]
    open_nodes = stitched.join(parent, "parent_key", "left").select(*names)
    children = swept.where("kind = 'child'").drop("parent_conv_id").join(parent, "parent_key").select(*names)
    return swept.where("kind = 'node'").select(*names).union(children).union(open_nodes)


def op13_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return nodes(rebuilt(turns_of(conversations)))


#: crc32 bit by bit: a byte is mixed in, then eight steps follow (-1).
_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda b: [ascii(b), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, e: CASE WHEN e >= 0 THEN xor(CAST(a AS BIGINT), CAST(e AS BIGINT)) ELSE xor(CAST(a AS BIGINT) >> 1, 3988292384 * (CAST(a AS BIGINT) & 1)) END), 4294967295)"

ORACLE = f"""
WITH u AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(r)) AS VARCHAR) || ':' || r || x)) AS ts FROM u GROUP BY c),
g AS (SELECT c, ts, CAST({_CRC} % {HEAD} AS BIGINT) AS h FROM t),
w AS (SELECT g.c, list_concat(coalesce(b.ts[:g.h], []), g.ts[g.h + 1:]) AS s FROM g LEFT JOIN t b ON b.c = g.c - g.c % {GROUP}),
p AS (SELECT c, s, unnest(generate_series(0, len(s))) AS d FROM w),
n AS (SELECT CASE WHEN d = 0 THEN [] ELSE s[:d] END AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len(s)), '') AS ends FROM p GROUP BY ALL),
i AS (SELECT *, CASE WHEN d < 2 THEN [] ELSE k[:d - 1] END AS up, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].x) END AS saved FROM n),
ch AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children, FROM i WHERE d > 0 GROUP BY ALL),
e AS (SELECT i.*, coalesce(ch.n_children, 0) AS n_children FROM i LEFT JOIN ch ON i.k = ch.k AND i.d = ch.d),
a AS (SELECT k, n_children, saved, unnest(generate_series(0, d)) AS j FROM e),
st AS (SELECT CASE WHEN j = 0 THEN [] ELSE k[:j] END AS k, j AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY ALL)
SELECT e.conv_id, e.d AS depth, o.conv_id AS parent_conv_id, e.n_convs, CAST(e.n_children AS BIGINT) AS n_children, CAST(st.n_leaves AS BIGINT) AS n_leaves, CAST(st.saved_tokens AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN st ON e.k = st.k AND e.d = st.d LEFT JOIN n o ON e.d > 0 AND o.d = e.d - 1 AND o.k = e.up
"""
