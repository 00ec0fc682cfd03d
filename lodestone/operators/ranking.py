"""Places in a total order, without one task that sorts everything; and broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.durable import table

#: Rows that a table may have to be broadcast on our word.
SMALL = 100_000


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the order, which has to be total: ranges are sorted apart, and offset by the sizes of those before."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # A row's number within its partition is the lower bits of this id, the partition the upper ones.
    held = table(dealt.withColumn("__id", F.monotonically_increasing_id()), "placed")
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in held.groupBy(part.alias("p")).agg(F.count("*")).collect())
    offsets, before = {}, 0
    for p, n in sizes:
        offsets[p], before = before, before + n
    start = F.create_map(*[F.lit(v).cast("long") for kv in offsets.items() for v in kv]) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return held.withColumn(name, start[part] + at + 1).drop("__id")


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """``rows`` marked for a broadcast if they are at most ``most``; else as they are, for Spark to choose."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
