"""Detectors of degenerate repetition in generated text, as expressions over one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

TAIL, MIN_REPEATS, MAX_UNIT, MIN_SHARE = 4000, 25, 30, 0.20

# Where sentences end, what makes one countable, and words of second thoughts.
SENTENCE_END = r"[。！？!?\n]+|\.[" + tx.SPACE + "]+"
COUNTABLE = "[A-Za-z0-9一-鿿]"
SECOND_THOUGHTS = "等等|但是|不过|然而|其实|让我|我们需要重新|重新想|换个思路|换个角度|我需要重新|我得重新|再想想|仔细想想"
SECOND_THOUGHTS_EN = r"(?i)\b(?:Wait|But|Actually|Hmm+|Let me|Let's|Alternatively|On second thought|Reconsider)\b"


def tail(c: Column | str, chars: int = TAIL) -> Column:
    t = tx.text(c)
    return F.when(F.length(t) > chars, F.right(t, F.lit(chars))).otherwise(t)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), tx.trim), lambda s: s != "")


def unit_counts(docs: DataFrame, parts: Column, countable: Column, id_col: str) -> DataFrame:
    """(id, n, unit, c, at): how often each countable unit stands in a text, and where it stood last."""
    each = docs.select(F.col(id_col).alias("id"), parts.alias("parts")).select("id", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "unit")).where(countable)
    return each.groupBy("id", "n", "unit").agg(F.count("*").alias("c"), F.max("at").alias("at"))


def repeated_units(docs: DataFrame, id_col: str = "id", text_col: str = "text", *, min_repeats: int = MIN_REPEATS, max_unit: int = MAX_UNIT, chars: int = TAIL, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, unit, count, share, hit): the most repeated short sentence of each text's tail.

    Of equally frequent units the one that got there first wins, as a running maximum has it.
    """
    parts = sentences(tail(text_col, chars))
    counts = unit_counts(docs, parts, (F.length("unit") <= max_unit) & F.col("unit").rlike(COUNTABLE), id_col)
    best = counts.groupBy("id").agg(F.max(F.struct("c", -F.col("at"), "unit", "n")).alias("m"))
    share = F.col("m.c") / F.col("m.n")
    hit = (F.col("m.n") >= min_repeats) & (F.col("m.c") >= min_repeats) & (share >= min_share)
    found = best.select("id", F.col("m.unit").alias("unit"), F.col("m.c").cast("int").alias("count"), share.alias("share"), hit.alias("hit"))
    ids = docs.select(F.col(id_col).alias("id"))
    return ids.join(found, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def word_count(c: Column) -> Column:
    """Words of letters, each run of digits counting as one sign."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "#"), f"[^a-z#{tx.SPACE}]", " ")
    return F.size(F.filter(F.split(t, f"[{tx.SPACE}]+"), lambda w: w != ""))


def rotation(docs: DataFrame, id_col: str = "id", text_col: str = "text", *, chars: int = TAIL, short_words: int = 3, short_share: float = 0.35, top_share: float = 0.5, min_parts: int = 25) -> DataFrame:
    """(id, parts, short_share, top_share, hit): whether a few short sentences take turns; fenced code is left out."""
    parts = sentences(F.regexp_replace(tail(text_col, chars), r"```[\s\S]*?```", " "))
    counts = unit_counts(docs, parts, F.col("unit").rlike(COUNTABLE), id_col)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "at"))
    top = counts.withColumn("place", place).where("place <= 5").groupBy("id").agg(F.sum("c").alias("top"))
    held = docs.select(F.col(id_col).alias("id"), parts.alias("parts")).select("id", F.size("parts").alias("parts"), F.size(F.filter("parts", lambda p: word_count(p) <= short_words)).alias("short"))
    held = held.join(top, "id", "left")
    n = F.nullif(F.col("parts"), F.lit(0))
    held = held.select("id", "parts", (F.col("short") / n).alias("short_share"), (F.coalesce("top", F.lit(0)) / n).alias("top_share"))
    hit = (F.col("parts") >= min_parts) & (F.col("short_share") >= short_share) & (F.col("top_share") >= top_share)
    return held.withColumn("hit", F.coalesce(hit, F.lit(False)))


def reflection(docs: DataFrame, id_col: str = "id", text_col: str = "text", *, chars: int = TAIL, least: int = 20, density: float = 0.35) -> DataFrame:
    """(id, hits, sentences, density, hit): the share of sentences with second thoughts."""
    held = docs.select(F.col(id_col).alias("id"), sentences(tail(text_col, chars)).alias("parts"))
    hits = F.size(F.filter("parts", lambda p: p.rlike(SECOND_THOUGHTS) | p.rlike(SECOND_THOUGHTS_EN)))
    share = hits / F.nullif(F.size("parts"), F.lit(0))
    return held.select("id", hits.alias("hits"), F.size("parts").alias("sentences"), share.alias("density"), F.coalesce((F.size("parts") >= least) & (share >= density), F.lit(False)).alias("hit"))


def degenerate_blocks(events: DataFrame, *, least: int = 400, with_rotation: bool = False) -> DataFrame:
    """(session, seq, block, unit, count, share, via): reasoning blocks of ``least`` characters or more that repeat themselves."""
    each = events.where("type = 'assistant/message'").select("session", "seq", F.posexplode("blocks").alias("block", "b")).where((F.col("b.type") == "reasoning") & (F.length("b.text") >= least))
    named = each.select(F.struct("session", "seq", "block").alias("id"), F.col("b.text").alias("text"))
    found = repeated_units(named).where("hit").select("id", "unit", "count", "share", F.lit("repeat").alias("via"))
    if with_rotation:
        turning = rotation(named).where("hit").join(found.select("id"), "id", "left_anti")
        found = found.unionByName(turning.select("id", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("count"), F.col("top_share").alias("share"), F.lit("rotation").alias("via")))
    return found.select("id.*", "unit", "count", "share", "via")
