"""Facts: parsing, flattening, incremental builds and exact-value lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.durable import table
from lodestone.functions import text as tx
from lodestone.operators.lexical import containing
from lodestone.schemas import OUTCOMES

_TRIPLES = "array<struct<subject string, predicate string, value string>>"


def parse_facts(raw: Column | str) -> Column:
    """Triples of a model's answer, a list or an object that holds one; blank or overlong ones are left out, null if there is no list."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    bare = F.from_json(raw, _TRIPLES.replace(" string", ": string"))
    held = F.from_json(raw, f"struct<triples: {_TRIPLES.replace(' string', ': string')}>")["triples"]
    found = F.when(tx.trim(tx.text(raw)).startswith("["), bare).otherwise(held)
    trimmed = F.transform(found, lambda t: F.struct(*[tx.trim(tx.text(t[k])).alias(k) for k in ("subject", "predicate", "value")]))
    fit = F.filter(trimmed, lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["value"] != "") & (F.length(t["subject"]) <= 60) & (F.length(t["predicate"]) <= 40) & (F.length(t["value"]) <= 300))
    return F.transform(fit, lambda t: F.struct(t["subject"].alias("subject"), t["predicate"].alias("predicate"), t["value"].alias("value"), tx.categorize(t["predicate"], t["value"]).alias("category")))


def flatten_facts(records: DataFrame) -> DataFrame:
    """One row a distinct triple of each record (id, level, project, updated_at, triples)."""
    each = records.select(F.col("id").cast("string").alias("src"), tx.text("level").alias("level"), tx.text("project").alias("project"), F.coalesce("updated_at", F.lit(0)).alias("updated_at"), F.explode("triples").alias("t"))
    flat = each.select("src", "level", "project", "updated_at", "t.subject", "t.predicate", "t.value", F.coalesce("t.category", tx.categorize(F.col("t.predicate"), F.col("t.value"))).alias("category"), F.col("updated_at").alias("src_updated_at"))
    return flat.dropDuplicates(["src", "subject", "predicate", "value"])


def plan_build(records: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: records, those to scan again, unchanged ones, and characters to send."""
    seen = scanned.select("id", F.col("updated_at").alias("seen_at"))
    joined = records.join(seen, "id", "left")
    stale = F.col("seen_at").isNull() | (F.col("seen_at") != F.coalesce("updated_at", F.lit(0)))
    return joined.agg(F.count("*").alias("records"), F.count_if(stale).alias("todo"), F.count_if(~stale).alias("unchanged"), F.coalesce(F.sum(F.when(stale, F.least(F.length(tx.text("content")), F.lit(3000)))), F.lit(0)).alias("chars"))


def merge_facts(old: DataFrame, new: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Old facts but those of sources that were scanned with success, whose new facts take their place."""
    return old.join(succeeded.select(F.col("id").alias("src")), "src", "left_anti").unionByName(new.join(succeeded.select(F.col("id").alias("src")), "src", "left_semi"))


def facts_route(queries: DataFrame, facts: DataFrame, entries: DataFrame | None = None, *, limit: int = 10) -> DataFrame:
    """(query_id, id, score, hits, examples): sources of facts whose value holds an exact value of the query.

    A fact is passed over where its source has changed since. ``entries`` is (id, updated_at).
    """
    wanted = queries.select("query_id", F.explode(tx.exact_values("query")).alias("x")).select("query_id", tx.normalize_value(F.col("x")).alias("x")).where("x <> ''")
    own = facts.withColumn("v", tx.normalize_value(F.col("value"))).where((F.col("v") != "") & (F.col("src").cast("string") != ""))
    if entries is not None:
        now = entries.select(F.col("id").alias("src"), F.col("updated_at").alias("now"))
        own = own.join(now, "src", "left").where("now IS NULL OR src_updated_at IS NULL OR now = src_updated_at")
    # The distinct values of the facts are walked once, for all values that the queries name.
    own = table(own.withColumn("fact", F.monotonically_increasing_id()), "facts")
    values = table(wanted, "wanted-values")
    held = containing(own.select("v").distinct(), values.select("x").distinct(), id_col="v", text_col="v", key_col="x", needle_col="x")
    met = own.join(held.select(F.col("id").alias("v"), F.col("key").alias("x")), "v").join(values, "x")
    each = met.groupBy("query_id", "src", "fact", "subject", "predicate", "value").agg(F.count("*").alias("matched"))
    score = 0.5 + F.least(F.lit(1.0), 0.2 * F.col("matched"))
    text = F.concat_ws("|", "subject", "predicate", "value")
    by_src = each.groupBy("query_id", F.col("src").alias("id")).agg(F.max(score).alias("score"), F.count("*").alias("hits"), F.slice(F.array_sort(F.collect_set(text)), 1, 2).alias("examples"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hits"), "id"))
    return by_src.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def validate_extraction(raw: Column | str) -> Column:
    """Reasons, by path, why a model's extraction breaks its contract; none where it keeps it. Texts are never quoted."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    v = F.try_parse_json(raw)
    keys, wanted = F.json_object_keys(raw), F.array(*map(F.lit, ("outcome", "summary", "triples")))
    is_object = F.coalesce(tx.trim(tx.text(raw)).startswith("{") & v.isNotNull(), F.lit(False))
    blank = lambda c: F.coalesce(tx.trim(c) == "", F.lit(True))
    as_text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    triples = F.try_variant_get(v, "$.triples", "array<variant>")
    inner = F.array(*map(F.lit, ("object", "predicate", "subject")))

    def broken(t: Column, k: Column) -> Column:
        j = F.to_json(t)
        at = F.concat(F.lit("/triples/"), k.cast("string"))
        own = lambda f: F.when(F.schema_of_variant(F.try_variant_get(t, f"$.{f}", "variant")) == "STRING", F.try_variant_get(t, f"$.{f}", "string"))
        fields = [F.when(blank(own(f)), F.concat(at, F.lit(f"/{f}: blank"))) for f in ("subject", "predicate", "object")]
        not_object = ~F.coalesce(F.schema_of_variant(t).startswith("OBJECT"), F.lit(False))
        return F.when(not_object, F.array(F.concat(at, F.lit(": not an object")))).otherwise(F.array_compact(F.array(F.when(~F.coalesce(F.array_sort(F.json_object_keys(j)) == inner, F.lit(False)), F.concat(at, F.lit(": wrong fields"))), *fields)))

    errors = F.concat(
        F.array_compact(
            F.array(
                F.when(~F.coalesce(F.array_sort(keys) == wanted, F.lit(False)), F.lit("/: wrong fields")),
                F.when(blank(as_text("$.summary")), F.lit("/summary: blank")),
                F.when(~F.coalesce(as_text("$.outcome").isin(*OUTCOMES), F.lit(False)), F.lit("/outcome: unknown")),
                F.when(triples.isNull(), F.lit("/triples: not a list")),
            )
        ),
        F.coalesce(F.flatten(F.transform(triples, broken)), F.array().cast("array<string>")),
    )
    return F.when(is_object, errors).otherwise(F.array(F.lit("/: not an object")))
