"""Language identification by averaged embeddings of hashed subwords and a linear softmax.

A text's subwords are the runs of two to four bytes within its words, blanks at
the words' ends included, hashed into BUCKETS. The mean of their embeddings goes through
a linear softmax; both are learned together by stochastic gradient descent. A part of the sample
is kept for a temperature, by which scores become calibrated probabilities; a text whose
language is less likely than ``least`` is rejected, as is one that has no letter.

Fitting uses at most SAMPLE texts, spread evenly over the languages; every whole text is predicted.
Defined results: a text that is null or has no letter is `und` with score 0; rows of null language
teach nothing; without any such row, or where no subword is left, the language is the most common one
(`und` if there is none); of equally likely languages the first in order wins; repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import by_batch, fitted, fold, session, text_bytes

#: Texts that the model is fitted on at most.
SAMPLE, PARTS = 2_000, 64
BUCKETS, SIZE, LEAST = 1 << 16, 12, 0.5
_SPREAD = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]

#: Letters lower-cased, all else a blank; bytes outside ASCII are parts of letters.
_PLAIN = np.where(np.isin(np.arange(256), [*range(97, 123), *range(128, 256)]), np.arange(256), 32).astype(np.uint8)
_PLAIN[65:91] = np.arange(97, 123)


def subwords(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets by text) of the subwords of each length."""
    texts, n = len(offsets) - 1, len(buf)
    # A blank before and after each text.
    spaced = np.full(n + texts + 1, 32, np.uint8)
    for k in range(texts):
        spaced[offsets[k] + k + 1 : offsets[k + 1] + k + 1] = _PLAIN[buf[offsets[k] : offsets[k + 1]]]
    edges = offsets + np.arange(texts + 1)
    solid = spaced != 32
    wide = spaced.astype(np.uint32)
    packed = wide[:-1] << np.uint32(8) | wide[1:]
    good = solid[:-1] | solid[1:]
    for k in range(3):
        if k:
            packed = packed[:-1] << np.uint32(8) | wide[k + 1 :]
            good = solid[1:-1] if k == 1 else solid[1:-2] & solid[2:-1]
        at = np.flatnonzero(good)
        yield ((packed[at] * _SPREAD[k]) >> np.uint32(16)).astype(np.int64), np.searchsorted(at, edges)


class Model:
    """Embeddings, softmax weights and temperature; ``table`` is their product, a row of scores for each subword."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 11) -> None:
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(v) for v in langs], np.int64)
        self.common = max(self.langs, key=langs.count, default="und")
        self.bias, self.temperature = np.zeros(max(1, len(self.langs))), 1.0
        rng = np.random.default_rng(seed)
        self.embedding = rng.uniform(-1, 1, (BUCKETS, SIZE)) / SIZE
        self.weight = np.zeros((SIZE, len(self.bias)))
        usable = np.array([i for i, r in enumerate(rows) if len(r[0])], np.int64)
        order = usable[rng.permutation(len(usable))] if len(usable) else usable
        kept = len(order) // 5 if len(order) >= 50 else 0
        if len(self.langs) > 1:
            self._fit([rows[i] for i in order[kept:]], y[order[kept:]], rng)
        self.table = (self.embedding @ self.weight).astype(np.float32)
        if kept and len(self.langs) > 1:
            logits = np.stack([self._mean(*rows[i]) @ self.weight + self.bias for i in order[:kept]])
            self.temperature = min(np.geomspace(0.2, 5, 33).tolist(), key=lambda t: -np.log(_softmax(logits / t)[np.arange(kept), y[order[:kept]]] + 1e-12).mean())
        del self.embedding

    def _mean(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (count / count.sum()) @ self.embedding[bucket]

    def _fit(self, rows, y, rng, epochs: int = 12, batch: int = 16, rate: float = 2.0) -> None:
        steps, total = 0, epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                own, now = order[lo : lo + batch], rate * (1 - steps / total)
                steps += 1
                mean = np.stack([self._mean(*rows[i]) for i in own])
                off = _softmax(mean @ self.weight + self.bias)
                off[np.arange(len(own)), y[own]] -= 1
                back = off @ self.weight.T
                self.weight -= now * mean.T @ off / len(own)
                self.bias -= now * off.mean(0)
                for i, g in zip(own, back):
                    bucket, count = rows[i]
                    # A text's buckets are distinct, so this adds up right.
                    self.embedding[bucket] -= now * (count / count.sum())[:, None] * g

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text of a buffer."""
        texts = len(offsets) - 1
        if not self.langs:
            return ["und"] * texts, np.zeros(texts)
        sums, counts = np.zeros((texts, len(self.langs))), np.zeros(texts)
        for bucket, first in subwords(buf, offsets):
            n = np.diff(first)
            full = np.flatnonzero(n)
            if len(full):
                sums[full] += np.add.reduceat(self.table[bucket], first[full], axis=0)
                counts += n
        p = _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        return [self.langs[k] if c else self.common for k, c in zip(best, counts)], p[np.arange(texts), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, counts = [], []
        for lo, hi, buf, offsets in tokens.slices(batch.column(2)):
            parts = list(subwords(buf, offsets))
            for k in range(hi - lo):
                b, c = np.unique(np.concatenate([x[f[k] : f[k + 1]] for x, f in parts]), return_counts=True)
                buckets.append(b.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["__id", "lang", "buckets", "counts"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` texts, as many of each language as it allows."""
    session(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"))
    # A language's ids are dealt over PARTS parts, each of which gives a bounded number, so the last ranking is of bounded size too.
    mark = F.xxhash64("__id")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(mark, "__id"))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(PARTS)))
    some = dealt.withColumn("nth", nth("lang", "part")).where(F.col("nth") <= max(1, sample * 4 // PARTS)).select("__id", "lang")
    taken = some.withColumn("nth", nth("lang")).where(F.col("nth") <= sample).orderBy("nth", "lang").limit(sample).groupBy("__id").agg(F.min("lang").alias("lang"))
    own = docs.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("text")).join(F.broadcast(taken), "__id")
    # Of texts that share an id, that of the least hash.
    own = own.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("m")).select("__id", "m.lang", "m.text")
    kind = docs.schema[id_col].dataType.simpleString()
    return fitted(own.mapInArrow(_gather, f"__id {kind}, lang string, buckets binary, counts binary"), _build)


def _build(langs: list[str], buckets: list[bytes], counts: list[bytes]) -> Model:
    return Model([(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32)) for b, c in zip(buckets, counts)], langs)


def _predictor(sent):
    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], [np.zeros(0)]
        for _, _, buf, offsets in tokens.slices(texts):
            lang, p = sent.value.predict(buf, offsets)
            langs += lang
            scores.append(p)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["lang", "score"])

    return run


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` as struct ``doc``, with ``lang_pred``, ``score`` and ``rejected``; reads nothing but the text."""
    sent = session(docs.sparkSession).sparkContext.broadcast(model)
    found = docs.select(F.struct("*").alias("doc"), by_batch(_predictor(sent), "lang string, score double", text_bytes(text_col)).alias("found"))
    letters = F.coalesce(F.col("doc")[text_col].rlike(r"\p{L}"), F.lit(False))
    found = found.select("doc", F.when(letters, F.col("found.lang")).otherwise("und").alias("lang_pred"), F.when(letters, F.col("found.score")).otherwise(0.0).alias("score"))
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < least))


def keep_identified(docs: DataFrame, *, least: float = LEAST, **options) -> DataFrame:
    """``docs`` without those whose language is rejected; all columns stay."""
    found = predict(docs, fit(docs, **options), text_col=options.get("text_col", "text"), least=least)
    return found.where("NOT rejected").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op9_subword_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    found = predict(docs.select("doc_id", "text"), model).select("doc.doc_id", "lang_pred", "score", "rejected")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
