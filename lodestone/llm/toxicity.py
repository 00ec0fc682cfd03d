"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the words' beginnings, hashed into BUCKETS; a term counts
once however often it stands there. The machine's score has a weight for each term and a
product of factors for each pair of terms, so it learns that an insult next to a group's name
means more than either alone. Terms without a clear relation to the label are left out
(likelihood ratio under G_LEAST), so thousands of neutral words in a long text don't drown the few that matter.

Fitting uses at most SAMPLE labelled rows, those of the smallest id hashes; scoring
covers every text. Defined results: null and empty texts have no terms and get the score of the bias;
a label that is null counts for nothing; of several labels of an id the largest counts; without
labels, or with labels of one kind, every score is the share of toxic labels; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import by_batch, fitted, fold, session, text_bytes

#: Labelled rows that the machine is fitted on at most.
SAMPLE = 16_000
BUCKETS, FACTORS, STEM, TERMS, G_LEAST = 1 << 18, 8, 5, 8_192, 12.0


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and of every longer word's beginning."""
    starts, ends, first = tokens.bounds(buf, offsets, tokens.ALNUM)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = tokens.hashes(buf, starts, ends)
    long = np.flatnonzero(ends - starts > STEM)
    stem = tokens.mix(tokens.hashes(buf, starts[long], starts[long] + STEM) ^ np.uint64(0x5DEECE66D))
    bucket = np.concatenate([whole, stem]) & np.uint64(BUCKETS - 1)
    return np.concatenate([text, text[long]]), bucket.astype(np.int64)


class Machine:
    """A fitted factorization machine; ``place`` maps a bucket to its term or -1."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> None:
        self.place = np.full(BUCKETS, -1, np.int32)
        toxic = int(labels.sum())
        share = (toxic + 0.5) / (len(labels) + 1) if len(labels) else 0.0
        self.bias = float(np.log(share / (1 - share))) if share else -20.0
        kept = self._chosen(rows, labels) if 0 < toxic < len(labels) else np.zeros(0, np.int64)
        self.place[kept] = np.arange(len(kept))
        self.weight = np.zeros(len(kept))
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (len(kept), FACTORS))
        if len(kept):
            self._fit([self.place[r][self.place[r] >= 0].astype(np.int64) for r in rows], labels.astype(np.float64), seed)

    @staticmethod
    def _chosen(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        """Buckets by likelihood ratio of presence and label."""
        with_term = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k]), minlength=BUCKETS).astype(np.float64) for k in (0, 1)]
        totals = [float((labels == k).sum()) for k in (0, 1)]
        n, present = sum(totals), with_term[0] + with_term[1]
        g = np.zeros(BUCKETS)
        for k in (0, 1):
            for seen, expected in ((with_term[k], present * totals[k] / n), (totals[k] - with_term[k], (n - present) * totals[k] / n)):
                g += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
        order = np.argsort(-g, kind="stable")[:TERMS]
        return np.sort(order[g[order] >= G_LEAST])

    def _fit(self, rows: list[np.ndarray], y: np.ndarray, seed: int, epochs: int = 50, batch: int = 128, rate: float = 0.15, shrink: float = 2e-5) -> None:
        rng = np.random.default_rng(seed + 1)
        square_w, square_v, square_b = np.full(len(self.weight), 1e-3), np.full(self.factor.shape, 1e-3), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                text = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
                term = np.concatenate([rows[i] for i in own])
                sums = self._sums(text, term, len(own))
                off = 1 / (1 + np.exp(-np.clip(self._logit(text, term, sums), -30, 30))) - y[own]
                g = off[text]
                grad_w = np.bincount(term, g, len(self.weight))
                grad_v = np.stack([np.bincount(term, g * (sums[text, f] - self.factor[term, f]), len(self.weight)) for f in range(FACTORS)], 1)
                touched = np.unique(term)
                grad_w, grad_v = grad_w[touched] / len(own) + shrink * self.weight[touched], grad_v[touched] / len(own) + shrink * self.factor[touched]
                square_w[touched] += grad_w**2
                square_v[touched] += grad_v**2
                self.weight[touched] -= rate * grad_w / np.sqrt(square_w[touched])
                self.factor[touched] -= rate / 4 * grad_v / np.sqrt(square_v[touched])
                square_b += off.mean() ** 2
                self.bias -= rate * off.mean() / np.sqrt(square_b)

    def _sums(self, text: np.ndarray, term: np.ndarray, texts: int) -> np.ndarray:
        return np.stack([np.bincount(text, self.factor[term, f], texts) for f in range(FACTORS)], 1)

    def _logit(self, text: np.ndarray, term: np.ndarray, sums: np.ndarray) -> np.ndarray:
        squares = np.bincount(text, (self.factor[term] ** 2).sum(1), len(sums))
        return self.bias + np.bincount(text, self.weight[term], len(sums)) + 0.5 * ((sums**2).sum(1) - squares)

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of the label 1 for each text of a buffer."""
        texts = len(offsets) - 1
        text, bucket = terms(buf, offsets)
        term = self.place[bucket]
        once = np.unique(text[term >= 0] * (len(self.weight) + 1) + term[term >= 0])
        text, term = once // (len(self.weight) + 1), once % (len(self.weight) + 1)
        if not len(self.weight):
            return np.full(texts, 1 / (1 + np.exp(-self.bias)))
        return 1 / (1 + np.exp(-np.clip(self._logit(text, term, self._sums(text, term, texts)), -30, 30)))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lo, hi, buf, offsets in tokens.slices(batch.column(2)):
            text, bucket = terms(buf, offsets)
            once = np.unique(text * BUCKETS + bucket)
            cut = np.searchsorted(once // BUCKETS, np.arange(hi - lo + 1))
            held = (once % BUCKETS).astype(np.int32)
            rows += [held[a:b].tobytes() for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["__id", "y", "terms"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled ids of ``docs``."""
    session(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    # At most ``sample`` rows of two numbers, so the broadcast is of a bounded size.
    taken = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    own = docs.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("text")).join(F.broadcast(taken), "__id")
    # Of texts that share an id, that of the least hash.
    own = own.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "y", "text")).alias("m")).select("__id", "m.y", "m.text")
    kind = docs.schema[id_col].dataType.simpleString()
    return fitted(own.mapInArrow(_gather, f"__id {kind}, y int, terms binary"), _build)


def _build(y: list[int], terms: list[bytes]) -> Machine:
    return Machine([np.frombuffer(b, np.int32) for b in terms], np.array(y, np.int64))


def _scorer(sent):
    def run(texts: pa.Array) -> pa.Array:
        found = [sent.value.scores(buf, offsets) for _, _, buf, offsets in tokens.slices(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return run


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``doc``, and ``score``; reads nothing but the text."""
    sent = session(docs.sparkSession).sparkContext.broadcast(machine)
    return docs.select(F.struct("*").alias("doc"), by_batch(_scorer(sent), "double", text_bytes(text_col)).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, most: float = 0.5, **options) -> DataFrame:
    """``docs`` without those that score ``most`` or more; all columns stay."""
    text_col = options.get("text_col", "text")
    found = score(docs, fit(docs, labels, **options), text_col=text_col)
    return found.where(F.col("score") < most).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op8_factorization_machine_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    machine = fit(docs, labels.where(fold("doc_id", 5) != 0))
    found = score(docs, machine).select("doc.doc_id", "score")
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
