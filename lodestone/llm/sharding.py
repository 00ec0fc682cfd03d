"""Shards of near equal size by sampled splitters, with DataFrame functions only.

Each record has a 64-bit key: the high bits from its text's hash, the low bits from its
id's and row's, so equal texts are neighbours in key order but a group of them, even of equal
ids, can be cut. Keys are drawn with a probability in proportion to the record's size; quantiles
of the sample bound the ranges; a range that turns out overfull is subdivided. Exact
sizes of the ranges and running sums within each give every record's place in the total
order, and so its shard: shards are cut where the running size passes a multiple of total / shards.

Defined results: a null text has size 1 (no bytes, plus one) and crc32 0; rows that are
equal in id and text are neighbours, in any order; an empty table has no rows; null ids sort first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_of, table, text_bytes

#: Ranges that are aimed at for each shard, and drawn keys for each range.
RANGES, DRAWS = 16, 16
#: Times the mean size at which a range is subdivided.
OVERFULL = 2.0
_LOW = 20


def _filled(rows: DataFrame, bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(range, size, rows, least key, largest key) of each range that has rows."""
    found = rows.groupBy(range_of(bounds, F.col("key")).alias("r")).agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key"))
    return sorted(tuple(x) for x in found.collect())


def splitters(rows: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int, int, int, int]]]:
    """Bounds of ranges of ``rows`` (key, size), and what each range holds."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    want = shards * RANGES
    if not total:
        return [], []
    # A draw is a Bernoulli trial that depends on the key and a second hash alone, so it can be repeated.
    chance = F.col("size") * (want * DRAWS / total)
    uniform = F.pmod(F.xxhash64(F.col("key"), F.col("tie"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(uniform < chance).select("key", F.greatest(F.lit(1), F.floor(chance)).alias("w"))
    # The number of draws is about want * DRAWS whatever the input; records that hold several draws count for them.
    keys = [k for k, w in sorted((r["key"], r["w"]) for r in drawn.collect()) for _ in range(w)]
    bounds = sorted({keys[k * len(keys) // want] for k in range(1, want)}) if keys else []
    filled = _filled(rows, bounds)
    for _ in range(4):
        more = set(bounds)
        for _, size, _, lo, hi in filled:
            parts = int(size / (OVERFULL / 2 * total / want))
            if size > OVERFULL * total / want and hi > lo:
                more |= {lo + (hi - lo) * k // parts for k in range(1, parts)} - {lo}
        if len(more) == len(bounds):
            break
        bounds = sorted(more)
        filled = _filled(rows, bounds)
    return bounds, filled


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(id, size, crc, shard, slot) of every row; ``size`` is the text's bytes plus one."""
    data = F.coalesce(text_bytes(text_col), F.lit(b""))
    row = F.monotonically_increasing_id()
    low = F.pmod(F.xxhash64(F.col(id_col).cast("string"), row), F.lit(1 << _LOW))
    key = F.shiftleft(F.shiftright(F.xxhash64(data), _LOW), _LOW).bitwiseOR(low)
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), key.alias("key"), row.alias("tie"))
    rows = table(slim, "shard-keys")
    bounds, filled = splitters(rows, shards)
    before, at = [], [0, 0]
    total = sum(x[1] for x in filled)
    for r, size, count, _, _ in filled:
        before.append((r, *at))
        at = [at[0] + size, at[1] + count]
    placed = rows.withColumn("r", range_of(bounds, F.col("key")))
    order = Window.partitionBy("r").orderBy("key", "id", "tie")
    base = {k: F.create_map(*[F.lit(v) for r, *x in before for v in (r, x[k])]) if before else F.create_map(F.lit(0), F.lit(0)) for k in (0, 1)}
    placed = placed.withColumns({"past": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "row": F.row_number().over(order) - 1})
    placed = placed.select("id", "size", "crc", (base[0][F.col("r")] + F.col("past")).alias("past"), (base[1][F.col("r")] + F.col("row")).alias("row"))
    placed = table(placed.withColumn("shard", F.expr(f"CAST(past * {shards} DIV {max(total, 1)} AS INT)")), "shards")
    first = {s: n for s, n in placed.groupBy("shard").agg(F.min("row")).collect()}
    start = F.create_map(*[F.lit(v).cast("long") for x in first.items() for v in x]) if first else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return placed.select("id", "size", "crc", "shard", (F.col("row") - start[F.col("shard").cast("long")]).alias("slot"))


def op6_sample_splitter_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = shard(docs, shards=16)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = None
