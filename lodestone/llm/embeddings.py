"""Near-duplicate embeddings by product quantisation over inverted lists.

Vectors are scaled to length one, so a cosine of at least t is a distance of at most
r = sqrt(2 - 2t). Equal vectors are one class. A class lies in the inverted list of its nearest coarse centre;
its residual is coded by subspace codebooks. If two classes of different lists link, the plane between the two centres
parts them, and the one nearer to it is within r / 2 of it; so each class asks the lists whose plane is that near,
and no link is lost. There table-lookup distances to the codes are summed; a code's own error, kept beside it, bounds
how far that is off, and only what the bound allows is reranked by exact cosine in double precision.

A list's members, and the classes that ask it, are dealt to blocks of BLOCK and ASK, and a pair of blocks is the unit of
work, so a list that holds a third of all vectors is spread over many tasks. Elsewhere a vector goes once to each list that it asks.
A unit returns the number of links of each class and a spanning forest of them, never all pairs.

Vectors of each length have centres, codebooks and lists of their own. These are fitted on a
sample of at most SAMPLE classes; every class is indexed and asks. Lists hold about LIST classes of the most frequent label,
but there are LISTS at least and an eighth of SAMPLE at most; a label of SMALL classes or fewer is one list.

Defined results: labels that are null or differ aren't compared, nor are vectors of different lengths; a vector
that is null, empty, zero, or has null or non-finite components links with nothing; rows
that repeat a vec_id are vectors of their own, whose links count for that id once each; vectors are known as equal by
their length and two 64-bit hashes; a null id isn't the smallest of anything. Labels are of any type that Spark can group by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import session, table, tidy

#: Vectors that centres and codebooks are fitted on at most, codes of a subspace, and dimensions of one.
SAMPLE, CODES, WIDTH = 16_384, 64, 4
#: Classes in a list, lists at least, classes of a label that is one list, and members and askers in a unit.
LIST, LISTS, SMALL, BLOCK, ASK = 256, 64, 32, 512, 2_048
_SLACK = 1e-5


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, centres)[0]
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, column, len(centres)) for column in x.T], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distances to all)."""
    d = _squares(x, centres)
    return d.argmin(1), d


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


class Quantiser:
    """Coarse centres, and codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        if not len(sample):
            sample = np.zeros((1, sample.shape[1] or 1))
        self.centres = _kmeans(sample, min(lists, max(1, len(sample) // 8)), 8, rng)
        rest = sample - self.centres[_nearest(sample, self.centres)[0]]
        self.parts = np.array_split(np.arange(sample.shape[1]), -(-sample.shape[1] // WIDTH))
        self.books = [_kmeans(rest[:, p], min(CODES, len(rest)), 6, rng) for p in self.parts]
        gaps = self.centres[:, None] - self.centres[None]
        self.gaps = np.sqrt((gaps * gaps).sum(2))

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error of the code) of vectors in given lists."""
        rest = x - self.centres[lists]
        codes = np.stack([_nearest(rest[:, p], b)[0] for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        off = rest - np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return codes, np.sqrt((off * off).sum(1))

    def asks(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(list, whether it asks each list) of vectors: own lists aside, those whose plane lies within half the radius."""
        near, d = _nearest(x, self.centres)
        asks = d - d[np.arange(len(x)), near][:, None] <= radius * self.gaps[near] + _SLACK
        asks[np.arange(len(x)), near] = False
        return near, asks

    def distances(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of vectors to the codes of a list, by lookup in their tables."""
        rest = x - self.centres[centre]
        out = np.zeros((len(x), len(codes)))
        for k, (p, book) in enumerate(zip(self.parts, self.books)):
            out += np.take(_squares(rest[:, p], book), codes[:, k], axis=1)
        return np.sqrt(np.maximum(out, 0))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    """Vectors as doubles of length one."""
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, initial=0, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(column: pa.Array) -> np.ndarray:
    """The values of a column of lists of one length, without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False)


def _bytes(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _fitter(dim: int, lists: int):
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        x = _unit(_flat(pa.Table.from_batches(held).sort_by("node").column("v").combine_chunks()), dim) if held else np.zeros((0, dim))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Quantiser(x, lists))], pa.binary())], names=["model"])

    return tidy(run)


def _fit(classes: DataFrame, dim: int, lists: int) -> Quantiser:
    """Fitted on at most SAMPLE classes, in one task; the driver gets the centres and codebooks alone."""
    import pickle

    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "v").coalesce(1)
    return pickle.loads(sample.mapInArrow(_fitter(dim, lists), "model binary").first()[0])


def _indexer(sent, dim: int, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, m, small, v = batch.columns
            flat = _flat(v)
            x = _unit(flat, dim)
            near, asks = sent.value.asks(x, radius)
            small = small.to_numpy(zero_copy_only=False)
            near[small], asks[small] = 0, False
            codes, errors = sent.value.code(x, near)
            first = np.concatenate(([0], np.cumsum(asks.sum(1)))).astype(np.int32)
            probes = pa.ListArray.from_arrays(pa.array(first), pa.array(np.nonzero(asks)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([node, label, m, pa.array(near.astype(np.int32)), _bytes(flat.reshape(-1, dim)), _bytes(codes), pa.array(errors), probes], names=["node", "label", "m", "list", "vector", "code", "error", "probes"])

    return tidy(run)


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever all the links do."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    found = []
    for a, b in zip(left.tolist(), right.tolist()):
        if (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
            found.append((a, b))
    return found


def linked(q: Quantiser, x: np.ndarray, y: np.ndarray, centre: int, codes: np.ndarray, errors: np.ndarray, least: float) -> np.ndarray:
    """Which of ``x`` link with which of ``y``, vectors of the list ``centre``."""
    maybe = q.distances(x, centre, codes) - errors <= np.sqrt(2 - 2 * least) + _SLACK
    out = np.zeros(maybe.shape, bool)
    some = np.flatnonzero(maybe.any(1))
    if len(some):
        out[some] = maybe[some] & (x[some] @ y.T >= least)
    return out


def _comparer(sent, dim: int, kind, least: float):
    def run(unit: pa.Table) -> pa.Table:
        asks = unit.column("asks").to_numpy()
        x, y = unit.filter(pa.array(asks)), unit.filter(pa.array(~asks))
        a, b, n = [], [], []
        if x.num_rows and y.num_rows:
            centre = unit.column("list")[0].as_py()
            vx, vy = (_unit(_matrix(t.column("vector"), kind, dim), dim) for t in (x, y))
            links = linked(sent.value, vx, vy, centre, _matrix(y.column("code"), np.uint8, len(sent.value.parts)), y.column("error").to_numpy(), least)
            i, j = np.nonzero(links)
            (nx, ny), (mx, my) = ([t.column(c).to_numpy() for t in (x, y)] for c in ("node", "m"))
            home = x.column("home").to_numpy()[i]
            # Where the member asks the asker's list too, the pair is met twice; it counts where the smaller one asks.
            probes = y.column("probes").to_pylist()
            twice = (home == centre) | np.array([h in probes[k] for h, k in zip(home.tolist(), j.tolist())], bool)
            kept = (nx[i] < ny[j]) | ((nx[i] > ny[j]) & ~twice)
            i, j = i[kept], j[kept]
            for who, weight in ((nx[i], my[j]), (ny[j], mx[i])):
                own, at = np.unique(who, return_inverse=True)
                a += own.tolist()
                n += np.bincount(at.ravel(), weight, len(own)).astype(np.int64).tolist()
            trees = _forest(nx[i], ny[j])
            b = [None] * len(a) + [v for _, v in trees]
            a, n = a + [u for u, _ in trees], n + [0] * len(trees)
        return pa.table([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

    return run


def _links(classes: DataFrame, dim: int, least: float, lists: int, kind) -> DataFrame:
    """(a, b, n): for classes of one length, the number of links of class ``a`` where ``b`` is null, else a link of a spanning forest."""
    sent = classes.sparkSession.sparkContext.broadcast(_fit(classes, dim, lists))
    label = classes.schema["label"].dataType.simpleString()
    index = classes.select("node", "label", "m", "small", "v").mapInArrow(_indexer(sent, dim, float(np.sqrt(2 - 2 * least))), f"node long, label {label}, m long, list int, vector binary, code binary, error double, probes array<int>")
    index = table(index, "codes")
    asking = index.select("node", "label", "m", "vector", F.col("list").alias("home"), F.explode(F.concat("probes", F.array("list"))).alias("list"))
    # A list's members and askers are dealt over as many blocks as they need; most lists are one unit.
    sizes = index.groupBy("label", "list").agg(F.count("*").alias("members")).join(asking.groupBy("label", "list").agg(F.count("*").alias("askers")), ["label", "list"])
    sizes = table(sizes.select("label", "list", F.ceil(F.col("members") / BLOCK).alias("ps"), F.ceil(F.col("askers") / ASK).alias("qs")), "lists")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    shared = ["label", "list", "p", "q", "asks", "node", "m", "vector", "home", "code", "error", "probes"]
    members = index.join(sizes, ["label", "list"]).withColumns({"p": part("ps"), "asks": F.lit(False), "home": F.col("list")}).withColumn("q", every("qs"))
    askers = asking.join(sizes, ["label", "list"]).withColumns({"q": part("qs"), "asks": F.lit(True), "code": F.lit(None).cast("binary"), "error": F.lit(0.0), "probes": F.lit(None).cast("array<int>")}).withColumn("p", every("ps"))
    units = members.select(*shared).union(askers.select(*shared)).repartition("label", "list", "p", "q")
    return table(units.groupBy("label", "list", "p", "q").applyInArrow(_comparer(sent, dim, kind, least), "a long, b long, n long"), "links")


def _usable(v: Column) -> Column:
    """Whether a vector is one of finite numbers that aren't all zero."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, lists: int | None = None) -> DataFrame:
    """(id, n_links, component) of every row of ``vectors``."""
    spark = session(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    found = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    # Two hashes stand for a vector; one starts from the other end.
    rows = table(found.withColumns({"usable": F.col("label").isNotNull() & _usable(F.col("v")), "h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), F.reverse("v")), "d": F.size("v")}), "vectors")
    same = ["label", "d", "h", "g"]
    classes = table(rows.where("usable").groupBy(*same).agg(F.min("row").alias("node"), F.count("*").alias("m"), F.first("v").alias("v")), "classes")
    labels = classes.groupBy("label", "d").agg(F.count("*").alias("c"))
    shapes = labels.groupBy("d").agg(F.max("c").alias("c")).where("c > 1").orderBy("d").collect()
    sized = classes.join(labels, ["label", "d"]).withColumn("small", F.col("c") <= SMALL)
    kind = np.float32 if single else np.float64
    parts = [_links(sized.where(F.col("d") == s["d"]), s["d"], least, lists or max(LISTS, -(-s["c"] // LIST)), kind) for s in shapes]
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "a long, b long, n long")

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    held = classes.select(*same, "node", "m").join(counts, "node", "left").join(roots, "node", "left")
    held = held.select(*same, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "node").alias("root"))
    # A class's smallest id is found before its rows meet, so that a hot class isn't dealt by its root.
    least_id = rows.where("usable").groupBy(*same).agg(F.min("id").alias("id"))
    smallest = held.join(least_id, same).groupBy("root").agg(F.min("id").alias("component"))
    told = held.join(smallest, "root").select(*same, "n", "component")
    out = rows.where("usable").select("id", *same).join(told, same).select("id", "n", "component")
    return out.union(rows.where("NOT usable").select("id", F.lit(0), "id")).select("id", F.col("n").cast("long").alias("n_links"), "component")


def op7_product_quantised_near_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    found = near_vectors(vectors, least=0.93)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(vec_id, o) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.o = l.x),
m AS (SELECT vec_id, min(o) AS c FROM r GROUP BY 1),
k AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.c AS component_id, m.vec_id = m.c AS kept FROM m LEFT JOIN k ON k.x = m.vec_id
"""
