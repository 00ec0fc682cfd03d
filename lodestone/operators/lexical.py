"""Lexical retrieval: postings, corpus statistics and two BM25 scorers.

Postings are a table (doc, term, tf, len) that can be stored and joined; a query set is
joined to it by term, so only postings of query terms are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.durable import is_there, table
from lodestone.functions import text as tx
from lodestone.operators.ranking import placed, small


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokens: Column | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, len) of every document, or of some ``terms`` only, which then are picked before anything is shuffled."""
    found = docs.select(F.col(id_col).alias("doc"), (tx.tokenize(text_col) if tokens is None else tokens).alias("t"))
    # A document's length travels with its terms, so it needs no join later.
    each = found.select("doc", F.explode("t").alias("term"), F.size("t").alias("len"))
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy("doc", "term", "len").agg(F.count("*").alias("tf")).select("doc", "term", "tf", "len")


def _few(terms: DataFrame) -> list[str] | None:
    """The distinct terms, if they are few."""
    found = terms.select("term").distinct().limit(FEW + 1).collect()
    return [r["term"] for r in found] if len(found) <= FEW else None


def _repeated(docs: DataFrame) -> bool:
    """Whether rows share a document (doc)."""
    return not docs.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def _counted(held: DataFrame, repeated: bool) -> DataFrame:
    """(doc, term, tf, len) of rows (doc, len, t); only where documents are repeated do their terms meet in a shuffle."""
    each = held.select("doc", "len", F.explode(tx.counted("t")).alias("c")).select("doc", "c.term", "c.tf", "len")
    return each.groupBy("doc", "term", "len").agg(F.sum("tf").alias("tf")).select("doc", "term", "tf", "len") if repeated else each


def sought(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``postings`` of some terms and ``corpus_stats`` of all documents; of few terms by one pass over the texts, which keeps only what is sought."""
    few = _few(terms)
    if few is None:
        return postings(docs, id_col, text_col, tokens, terms), corpus_stats(docs, text_col, tokens)
    found = docs.select(F.col(id_col).alias("doc"), (tx.tokenize(text_col) if tokens is None else tokens).alias("t"))
    held = table(found.select("doc", F.size("t").alias("len"), F.filter("t", lambda x: x.isin(few)).alias("t")), "sought-tokens")
    return _counted(held, _repeated(held)), _stats(held, F.col("len"))


def document_frequency(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row (n, avgdl) of all documents, those without terms included."""
    return _stats(docs, tx.token_count(text_col) if tokens is None else F.size(tokens))


def _stats(docs: DataFrame, length: Column) -> DataFrame:
    stats = docs.agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    mean = F.coalesce(F.col("total"), F.lit(0)) / F.greatest("n", F.lit(1))
    return stats.select("n", F.when(mean > 0, mean).otherwise(1.0).alias("avgdl"))


#: Terms of a query set that are sought by a filter.
FEW = 200


@dataclass
class Index:
    """Stored postings: (doc, term, tf, len) in files that each are sorted by term, and (doc, len) of every document."""

    postings: DataFrame
    lengths: DataFrame

    def of(self, terms: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """Postings of some terms, and of some documents (id) only where they are given."""
        few = _few(terms)
        # A few terms are a filter of the scan, which reads only the row groups that can hold them.
        found = self.postings.where(F.col("term").isin(few)) if few is not None else self.postings.join(terms.select("term").distinct(), "term", "left_semi")
        return found if docs is None else found.join(docs.select(F.col("id").alias("doc")), "doc", "left_semi")

    def stats(self, docs: DataFrame | None = None) -> DataFrame:
        """One row (n, avgdl) of all documents, or of some (id)."""
        own = self.lengths if docs is None else self.lengths.join(docs.select(F.col("id").alias("doc")), "doc", "left_semi")
        return _stats(own, F.col("len"))


def build_index(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokens: Column | None = None) -> Index:
    """Postings of all documents, written once. A task counts and sorts the terms of its own documents, so nothing is shuffled; a query reads its terms' row groups of each file."""
    ids = docs.select(F.col(id_col).alias("doc"))
    found = docs.select(F.col(id_col).alias("doc"), (tx.tokenize(text_col) if tokens is None else tokens).alias("t")).select("doc", F.size("t").alias("len"), "t")
    # A row without a term stands for the document, so its length comes of the same pass.
    own = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
    if _repeated(ids):
        each = _counted(found, True).union(found.select("doc", own["term"], own["tf"], "len"))
    else:
        each = found.select("doc", "len", F.explode(F.concat(F.array(own), tx.counted("t"))).alias("c")).select("doc", "c.term", "c.tf", "len")
    stored = table(each.sortWithinPartitions("term", "doc"), "postings")
    found = stored.where("term IS NOT NULL")
    found._table_path = stored._table_path
    return Index(found, table(stored.where("term IS NULL").select("doc", "len"), "lengths"))


_INDEXES: dict[tuple, Index] = {}


def stored_index(spark: SparkSession, path: str, id_col: str, text: Column | str, full_text: bool = False) -> Index:
    """The index of a Parquet table's texts, built when it is first asked for and again when the table's files have changed."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, id_col, str(text), full_text, *sorted(map(tuple, files)))
    held = _INDEXES.get(key)
    if held is None or not (is_there(held.postings) and is_there(held.lengths)):
        docs = spark.read.parquet(path).select(F.col(id_col).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
        cores = spark.sparkContext.defaultParallelism
        # A small file is one split; large tables have splits enough.
        docs = docs.repartition(cores) if len(files) < cores else docs
        _INDEXES[key] = build_index(docs, tokens=full_text_tokens("text") if full_text else None)
    return _INDEXES[key]


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tx.tokenize(text_col))).alias("term"))


def _scores(found: DataFrame, stats: DataFrame, terms: DataFrame, idf: Column, k1: float, b: float) -> DataFrame:
    # Weights of few terms go to the postings, so those of a frequent term don't meet in one task.
    hits = found.join(small(table(_weights(found, stats, terms, idf), "weights")), "term").crossJoin(F.broadcast(stats))
    part = F.col("weight") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc").agg(F.sum(part).alias("score")).where("score > 0")


def bm25(found: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc, score) of all documents that share a term with a query."""
    return _scores(found, stats, terms, F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), k1, b)


def bm25_full_text(found: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The full-text index's variant: a plain idf that is never under 1e-6."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _scores(found, stats, terms, F.when(idf <= 0, 1e-6).otherwise(idf), k1, b)


#: Cells of the grid of documents and terms that is scored at once, queries in a block, postings in a block of documents, and terms of all queries that are broadcast.
_GRID, _QUERIES, _BLOCK_POSTINGS, _BROADCAST_TERMS = 1 << 21, 1024, 1 << 20, 1 << 22


def _packed(ids: pa.DataType):
    """Rows (doc, number, part) in order of doc as blocks (docs, sizes, numbers, parts); a document is in one block, whatever batches it came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            runs = pa.compute.run_end_encode(rows.column("doc").combine_chunks())
            docs, ends = runs.values, runs.run_ends.to_numpy()
            parts = (np.diff(ends, prepend=0).astype("<i4"), rows.column("number").to_numpy().astype("<i4"), rows.column("part").to_numpy().astype("<f8"))
            return pa.RecordBatch.from_arrays([pa.array([docs.to_pylist()], pa.list_(ids)), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["docs", "sizes", "numbers", "parts"])

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= _BLOCK_POSTINGS:
                whole = pa.concat_tables(held)
                docs = whole.column("doc")
                # The last document goes on in the next batch, perhaps.
                cut = pa.compute.index(docs, docs[rows - 1]).as_py()
                if cut:
                    yield block(whole.slice(0, cut))
                    held, rows = [whole.slice(cut)], rows - cut
        if rows:
            yield block(pa.concat_tables(held))

    return run


def _best(k: int, ids: pa.DataType, keys: pa.DataType):
    """Of blocks of documents beside blocks of queries, each query's k best of a block, and in its first row how many have a score at all."""

    def scored(block: dict, queries: list) -> tuple:
        sizes, numbers, parts = (np.frombuffer(block[n], t) for n, t in (("sizes", "<i4"), ("numbers", "<i4"), ("parts", "<f8")))
        starts, docs = np.concatenate([[0], np.cumsum(sizes)]), block["docs"]
        asked = [(np.array(q["numbers"], np.int64), np.array(q["weights"])) for q in queries]
        terms = np.unique(np.concatenate([n for n, _ in asked])) if asked else np.zeros(0, np.int64)
        at = [np.searchsorted(terms, n) for n, _ in asked]
        step = max(64, _GRID // max(1, len(terms)))
        # A query's best so far, which later documents of the block join.
        best: list[tuple[np.ndarray, np.ndarray, int]] = [(np.zeros(0, np.int64), np.zeros(0), 0)] * len(asked)
        for lo in range(0, len(docs), step):
            hi = min(lo + step, len(docs))
            own, which = numbers[starts[lo] : starts[hi]], np.repeat(np.arange(hi - lo), sizes[lo:hi])
            place = np.minimum(np.searchsorted(terms, own), max(0, len(terms) - 1))
            met = terms[place] == own if len(terms) else np.zeros(len(own), bool)
            grid = np.zeros((len(terms), hi - lo))
            grid[place[met], which[met]] = parts[starts[lo] : starts[hi]][met]
            for n, (_, weights) in enumerate(asked):
                s = weights @ grid[at[n]]
                live = np.flatnonzero(s > 0)
                if not len(live):
                    continue
                where, held, count = best[n]
                where, held, count = np.concatenate([where, lo + live]), np.concatenate([held, s[live]]), count + len(live)
                if len(where) > k:
                    # Ties with the k-th stay, for their ids to decide.
                    level = held.round(9)
                    kept = level >= np.partition(level, len(level) - k)[len(level) - k]
                    where, held = where[kept], held[kept]
                best[n] = where, held, count
        for n, (where, held, count) in enumerate(best):
            if count:
                yield n, where, held, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1).to_pylist()[0]
                queries, docs = block["queries"], pa.array(block["docs"], ids)
                found = list(scored(block, queries))
                if not found:
                    continue
                sizes = [len(live) for _, live, _, _ in found]
                counts = np.zeros(sum(sizes), np.int64)
                counts[np.cumsum([0, *sizes[:-1]])] = [c for *_, c in found]
                names = pa.array([q["query_id"] for q in queries], keys).take(pa.array(np.repeat([n for n, *_ in found], sizes)))
                yield pa.RecordBatch.from_arrays([names, docs.take(pa.array(np.concatenate([live for _, live, _, _ in found]))), pa.array(np.concatenate([x for _, _, x, _ in found])), pa.array(counts)], names=["query_id", "doc", "score", "n"])

    return run


def best_of_each(found: DataFrame, weights: DataFrame, part: Column, k: int) -> DataFrame:
    """(query_id, doc, score, rank, n): each query's k best documents by the sum of weight times ``part`` over the terms they share, and how many share any.

    ``weights`` is (query_id, term, weight), each term once a query; ``part`` is of the postings ``found``. Scores that agree to nine places go by id.
    Postings are brought together by document and scored there against blocks of queries, so no pair of query and document leaves a task unless it is
    among the k best of its block of documents: what is written grows with the postings and with k a query and block, not with the pairs.
    """
    numbers = placed(weights.select("term").distinct(), "term", name="number").withColumn("number", F.col("number").cast("int"))
    asked = table(weights.join(numbers, "term").select("query_id", "number", "weight"), "query-terms")
    each = asked.groupBy("query_id").agg(F.collect_list(F.struct("number", "weight")).alias("t"))
    each = table(each.select("query_id", F.struct("query_id", F.col("t.number").alias("numbers"), F.col("t.weight").alias("weights")).alias("q")), "query-weights")
    blocks = max(1, -(-each.count() // _QUERIES))
    queries = each.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b")).agg(F.collect_list("q").alias("queries")).select("queries")
    # Blocks of queries hold 12 bytes a query's term.
    queries = F.broadcast(queries) if asked.count() <= _BROADCAST_TERMS else queries
    own = found.join(small(numbers), "term").select("doc", "number", part.cast("double").alias("part"))
    cores = found.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind, key = found.schema["doc"].dataType, weights.schema["query_id"].dataType
    ids, keys = to_arrow_type(kind), to_arrow_type(key)
    packed = own.repartition(parts, "doc").sortWithinPartitions("doc").mapInArrow(_packed(ids), f"docs array<{kind.simpleString()}>, sizes binary, numbers binary, parts binary")
    met = packed.crossJoin(queries).mapInArrow(_best(k, ids, keys), f"query_id {key.simpleString()}, doc {kind.simpleString()}, score double, n long")
    met = table(met, "best-of-blocks")
    count = met.groupBy("query_id").agg(F.sum("n").alias("n"))
    return top_k(met.drop("n"), k).join(count, "query_id")


def _weights(found: DataFrame, stats: DataFrame, terms: DataFrame, idf: Column) -> DataFrame:
    return terms.join(document_frequency(found), "term").crossJoin(F.broadcast(stats)).select("query_id", "term", idf.alias("weight"))


def _saturated(found: DataFrame, stats: DataFrame, k1: float, b: float) -> tuple[DataFrame, Column]:
    held = found.crossJoin(F.broadcast(stats.select("avgdl")))
    return held, F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))


def bm25_best(found: DataFrame, stats: DataFrame, terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best of ``bm25`` for each query, as ``best_of_each`` gives them."""
    held, part = _saturated(found, stats, k1, b)
    weights = _weights(found, stats, terms, F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return best_of_each(held, weights, part, k)


def bm25_full_text_best(found: DataFrame, stats: DataFrame, terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best of ``bm25_full_text`` for each query, as ``best_of_each`` gives them."""
    held, part = _saturated(found, stats, k1, b)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = _weights(found, stats, terms, F.when(idf <= 0, 1e-6).otherwise(idf))
    return best_of_each(held, weights, part, k)


def full_text_tokens(c: Column | str) -> Column:
    """What the full-text index keeps of the tokenized text: runs of letters and digits, accents dropped."""
    plain = F.translate(F.array_join(tx.tokenize(c), " "), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# Accented Latin letters and their bases.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def substring_route(turns: DataFrame, needle: str, limit: int = 200) -> DataFrame:
    """(id, score) of the newest turns that hold the needle, letters A-Z folded; cut before any other filter."""
    fold = lambda c: F.translate(tx.text(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = fold(F.lit(needle))
    found = turns.where(F.contains(fold("user_text"), wanted) | F.contains(fold("answer_text"), wanted))
    newest = found.orderBy(F.desc("updated_at"), "id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")) - 1
    return newest.select("id", (19 - rank * 0.1).alias("score"))


#: Letters of the needles that one automaton holds, and of one needle that go into it; longer ones are compared whole where these are found.
_BLOCK_LETTERS, _NEEDLE_LETTERS = 1 << 20, 1 << 10


def _walked(needles: list[tuple[int, str]]):
    """Which of the needles each text holds, by an automaton that goes through it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, needle in needles:
            automaton.add_word(needle, (*automaton.get(needle, ()), number))
        automaton.make_automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, found = [], []
                for k, text in enumerate(batch.column(1).slice(at, 256)):
                    held = set()
                    for _, numbers in automaton.iter(text.as_py()):
                        held.update(numbers)
                    rows += [at + k] * len(held)
                    found += sorted(held)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], names=["id", "number"])

    return run


def containing(texts: DataFrame, needles: DataFrame, *, id_col: str = "id", text_col: str = "text", key_col: str = "query_id", needle_col: str = "query") -> DataFrame:
    """(key, id): which needles occur in which texts, letter by letter.

    Needles are dealt into blocks of a bounded number of letters; each block is an Aho-Corasick automaton, and a pass over the
    texts walks it once a text, whatever the number of needles. Null texts, needles and ids are in no pair; an empty needle is in every text.
    """
    asked = needles.select(F.col(key_col).alias("key"), F.col(needle_col).alias("needle")).where("key IS NOT NULL AND needle IS NOT NULL").distinct()
    held = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    distinct = table(asked.where("needle <> ''").select("needle").distinct().withColumn("number", F.monotonically_increasing_id()), "needles")
    head = F.substring("needle", 1, _NEEDLE_LETTERS)
    letters = distinct.agg(F.sum(F.length(head))).first()[0] or 0
    blocks = -(-letters // _BLOCK_LETTERS)
    schema = f"id {held.schema['id'].dataType.simpleString()}, number long"
    pairs = held.select("id", F.lit(0).cast("long").alias("number")).limit(0)
    for k in range(blocks):
        # One block at a time is with the driver; what it finds is written before the next is fetched.
        block = [tuple(r) for r in distinct.where(F.pmod("number", F.lit(blocks)) == k).select("number", head).collect()]
        pairs = pairs.unionByName(table(held.select("id", "text").mapInArrow(_walked(block), schema), "needles-found"))
    whole = pairs.join(distinct, "number").join(asked, "needle")
    short = F.length("needle") <= _NEEDLE_LETTERS
    met = whole.where(short).select("key", "id")
    if distinct.where(~short).limit(1).count():
        met = met.union(whole.where(~short).join(held, "id").where(F.contains("text", F.col("needle"))).select("key", "id"))
    empty = asked.where("needle = ''").select("key")
    if empty.limit(1).count():
        met = met.union(held.select("id").crossJoin(small(empty)).select("key", "id"))
    return met.distinct()


def words_within(texts: DataFrame, words: DataFrame, *, id_col: str = "id", text_col: str = "text", word_col: str = "word", letters: str = "a-z", anchor: int = 6) -> DataFrame:
    """(id, word): which words occur in which texts, inside longer words too.

    Words are of ``letters`` alone and have ``anchor`` of them at least; others are left out, as are nulls. A text's words are looked up from each place
    by the first ``anchor`` letters there, so a pair is met only where it shares these. No more of a place is kept than the longest word has letters.
    """
    own = words.select(F.col(word_col).alias("word")).where(F.col("word").rlike(f"^[{letters}]{{{anchor},}}$")).distinct()
    own = own.withColumn("start", F.substring("word", 1, anchor))
    longest = own.agg(F.max(F.length("word"))).first()[0] or anchor
    runs = F.array_distinct(F.regexp_extract_all(text_col, F.lit(f"[{letters}]{{{anchor},}}"), F.lit(0)))
    run = texts.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    place = run.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - (anchor - 1)), lambda k: F.substring("run", k, F.lit(longest)))).alias("rest"))
    place = place.distinct().withColumn("start", F.substring("rest", 1, anchor))
    return place.join(own, "start").where(F.startswith("rest", F.col("word"))).select("id", "word").distinct()


def top_k(scored: DataFrame, k: int, by: str = "query_id", tie: str = "doc") -> DataFrame:
    """The k best of each query, with their rank from 0. Scores that agree to nine places are equal, as sums depend on their order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), tie))
    return scored.withColumn("rank", rank - 1).where(F.col("rank") < k)
