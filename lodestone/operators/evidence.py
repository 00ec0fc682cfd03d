"""Where a memory comes from: edit histories resolved to turns of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.durable import table
from lodestone.functions import text as tx

# Fixed value: one edit, as scene-action-session-turn(n) or ...-turnRange(a,b).
EDIT = r"^([a-z][a-z0-9]*)-([a-z][a-z0-9]*)-([0-9a-z]{4,64})-(turn\((\d+)\)|turnRange\((\d+),(\d+)\))$"


def parse_edits(history: Column | str) -> Column:
    """Structs (raw, unparsed, scene, action, session, turn, low, high) of the edits; a range's own turn is its upper end."""
    each = F.filter(F.transform(F.split(tx.text(history), ";"), tx.trim), lambda e: e != "")

    def parse(e: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(e, EDIT, k), F.lit(""))
        number = lambda k: part(k).try_cast("int")
        return F.struct(e.alias("raw"), (~e.rlike(EDIT)).alias("unparsed"), part(1).alias("scene"), part(2).alias("action"), part(3).alias("session"), F.coalesce(number(5), number(7)).alias("turn"), number(6).alias("low"), number(7).alias("high"))

    return F.transform(each, parse)


def material_range(edit: Column) -> Column:
    """The turns that an edit worked on, as (low, high): its turn, or those of its range but the last."""
    low = F.greatest(F.coalesce(edit["low"], F.lit(1)), F.lit(1))
    ranged = edit["low"].isNotNull()
    return F.struct(F.when(ranged, low).otherwise(edit["turn"]).alias("low"), F.when(ranged, F.greatest(low, edit["high"] - 1)).otherwise(edit["turn"]).alias("high"))


def named_by(names: DataFrame, sessions: DataFrame) -> DataFrame:
    """(wanted, session): the sessions whose short names begin with the wanted ones.

    A session is looked up by its beginnings of the lengths that are wanted, 4 to 64 characters, so only those that begin alike meet.
    """
    wanted = names.select("wanted").where("wanted IS NOT NULL").distinct()
    lengths = sorted(r[0] for r in wanted.select(F.length("wanted")).distinct().collect())
    short = F.regexp_replace("session", "^session-", "")
    own = sessions.select("session").where("session IS NOT NULL").distinct().select("session", short.alias("short"))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("short")), lambda n: F.substr("short", F.lit(1), n))
    return own.select("session", F.explode(starts).alias("wanted")).join(wanted, "wanted").select("wanted", "session")


def locate(items: DataFrame, groups: DataFrame, *, most: int = 6) -> DataFrame:
    """(id, edit_no, scene, action, session, abs, user_seq, quote): the turns of each edit that a real user began, the first ``most`` of them.

    ``items`` is (id, edit_history); ``groups`` is (session, abs, user_seq, quote), whose sessions may carry a longer name. An interval
    join: a name's turn numbers are counted, an edit's interval begins at the count of the first number in it and looks at ``most`` of them from there,
    however wide it is.
    """
    edits = items.select("id", F.posexplode(parse_edits("edit_history")).alias("edit_no", "e")).where("NOT e.unparsed")
    each = edits.select("id", "edit_no", "e.scene", "e.action", F.col("e.session").alias("wanted"), material_range(F.col("e")).alias("r"))
    each = table(each.select("id", "edit_no", "scene", "action", "wanted", "r.low", "r.high").where("low IS NOT NULL"), "edits")
    known = groups.where("user_seq IS NOT NULL").select("session", "abs", "user_seq", "quote")
    own = known.join(named_by(each, known), "session")
    # No edit needs more than so many sessions of one number; Spark cuts them before the shuffle as well.
    nth = F.row_number().over(Window.partitionBy("wanted", "abs").orderBy("session", "user_seq"))
    own = own.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    numbers = own.select("wanted", "abs").distinct().withColumn("k", F.row_number().over(Window.partitionBy("wanted").orderBy("abs")))
    numbers = table(numbers, "turn-numbers")
    # The first number of a name that is at least an edit's low one: from the largest down, the last number that was passed.
    down = Window.partitionBy("wanted").orderBy(F.desc("at"), F.desc_nulls_last("k")).rowsBetween(Window.unboundedPreceding, 0)
    lows = each.select("wanted", F.col("low").alias("at")).distinct().withColumn("k", F.lit(None).cast("int"))
    first = numbers.select("wanted", F.col("abs").alias("at"), "k").unionByName(lows).withColumn("first", F.last("k", True).over(down)).where("k IS NULL AND first IS NOT NULL")
    begun = each.join(first.select("wanted", F.col("at").alias("low"), "first"), ["wanted", "low"])
    asked = begun.withColumn("k", F.explode(F.sequence("first", F.col("first") + (most - 1)))).join(numbers, ["wanted", "k"]).where("abs <= high")
    met = asked.join(own, ["wanted", "abs"])
    place = F.row_number().over(Window.partitionBy("id", "edit_no").orderBy("abs", "session"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("id", "edit_no", "scene", "action", "session", "abs", "user_seq", "quote")


def latest_evidence(located: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, session, user_seq, turn_index, quote): for each item its last edit that resolves."""
    last = located.groupBy("id").agg(F.max_by(F.struct("session", "user_seq", "quote"), F.struct("edit_no", -F.col("abs"))).alias("m")).select("id", "m.*")
    own = turns.select(F.col("session_id").alias("session"), "user_seq", "turn_index")
    return last.join(own, ["session", "user_seq"], "left").select("id", "session", "user_seq", "turn_index", "quote")


def refreshed_alignment(files: DataFrame, cached: DataFrame, read) -> DataFrame:
    """Turn groups of log files (session, path, modified, size), those of unchanged files from ``cached`` (path, modified, size, session, abs, user_seq, quote).

    ``read`` makes groups (session, abs, user_seq, quote) of the files that it is given, which are only the changed ones.
    """
    key = ["path", "modified", "size"]
    held = cached.join(files.select(*key), key, "left_semi")
    changed = files.join(cached.select(*key).distinct(), key, "left_anti")
    fresh = read(changed).join(changed.select("session", *key), "session")
    return held.unionByName(fresh.select(*held.columns))


def wanted_sessions(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """The sessions (session, ...) that any edit of the items (id, edit_history) names, by the short name or its beginning."""
    edits = items.select(F.explode(parse_edits("edit_history")).alias("e")).where("NOT e.unparsed").select(F.col("e.session").alias("wanted"))
    return sessions.join(named_by(edits, sessions).select("session").distinct(), "session", "left_semi")
