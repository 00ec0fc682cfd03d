"""As-of joins: the newest mark before a time, without comparing every time with every mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.durable import table


def newest_before(asked: DataFrame, marks: DataFrame) -> DataFrame:
    """(name, at, mark, mark_at): for each of ``asked`` (name, at) the newest of ``marks`` (name, at) that isn't later and has another name.

    Of marks of one time the largest name counts. Both are range-sorted together by time; each partition carries its last two marks along,
    and the last two of a partition go on to the next ones that need them, so neither a time nor a name has to fit one task. Null
    names and times count for nothing; who finds no mark has no row.
    """
    names = "name IS NOT NULL AND at IS NOT NULL"
    both = marks.select("name", F.col("at").cast("long").alias("at"), F.lit(0).alias("asks")).where(names).distinct()
    both = both.unionByName(asked.select("name", F.col("at").cast("long").alias("at"), F.lit(1).alias("asks")).where(names))
    parts = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartitionByRange(parts, "at", "asks", "name").sortWithinPartitions("at", "asks", "name")
    # A row's place within its partition is the lower bits of this number, the partition the upper ones.
    dealt = dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33))
    held = table(dealt, "as-of")

    mark = F.when(F.col("asks") == 0, F.struct(F.col("at").alias("mark_at"), F.col("name").alias("mark")))
    order = Window.partitionBy("part").orderBy("place")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    own = held.withColumns({"last": F.last(mark, True).over(so_far), "previous": F.last(mark, True).over(before)})
    # The newest mark of another name than the last one's is the one before the last change of names.
    changed = F.when((F.col("asks") == 0) & (F.col("previous.mark") != F.col("name")), F.col("previous"))
    own = own.withColumn("other", F.last(changed, True).over(so_far))

    # Of each partition its last mark and the last of another name: two rows a partition are carried along.
    newest = held.where("asks = 0").groupBy("part", "name").agg(F.max("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("at"), F.desc("name")))
    ends: dict[int, list[tuple[int, str]]] = {}
    for r in newest.withColumn("nth", nth).where("nth <= 2").collect():
        ends.setdefault(r["part"], []).append((r["at"], r["name"]))
    carried, two = [], []
    for (p,) in held.select("part").distinct().orderBy("part").collect():
        carried.append((p, *two[::-1], *[None] * (2 - len(two))))
        by_name = {name: at for at, name in sorted(two + ends.get(p, []))}
        two = sorted((at, name) for name, at in by_name.items())[-2:]
    kind = "struct<mark_at:bigint,mark:string>"
    carry = held.sparkSession.createDataFrame(carried, f"part bigint, carry {kind}, carry_other {kind}")

    met = own.where("asks = 1").join(F.broadcast(carry), "part")
    found = F.array_compact(F.array("last", "other", "carry", "carry_other"))
    best = F.array_max(F.filter(found, lambda m: m["mark"] != F.col("name")))
    return met.select("name", "at", best.alias("m")).where("m IS NOT NULL").select("name", "at", "m.mark", "m.mark_at")
