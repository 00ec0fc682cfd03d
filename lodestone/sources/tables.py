"""Versioned tables, JSON documents, embedding services and append-only ledgers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx


def publish(df: DataFrame, path: str) -> str:
    """Write a new version of a table, read all of it back, and only then name it as the current one."""
    spark = df.sparkSession
    version = f"{path}/v{time.time_ns()}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(version)
    back = spark.read.parquet(version)
    # Every column is read, so a page that can't be is found now; nothing else sees the version yet.
    if back.agg(F.count("*"), F.max(F.xxhash64(*[F.to_json(F.struct(c)) for c in back.columns]))).first()[0] != seen.get["rows"]:
        raise OSError(f"{version} has fewer rows than were written")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{path}/_versions")
    return version


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version of a table; with a schema, missing columns are null."""
    version = spark.read.schema("version string").json(f"{path}/_versions").agg(F.max("version")).first()[0]
    df = spark.read.parquet(version)
    if schema is None:
        return df
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_document(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of a list within a JSON document; none if it has no such list."""
    docs = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", "true").json(path)
    return docs.select(F.inline(field))


def migrate(df: DataFrame, version: int, steps: list[Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, int]:
    """A table of schema ``version`` brought to that of all ``steps``, of which the first ``version`` are done."""
    if not 0 <= version <= len(steps):
        raise ValueError(f"the table's version {version} is newer than this engine's {len(steps)}")
    for step in steps[version:]:
        df = step(df)
    return df, len(steps)


def append_ledger(df: DataFrame, path: str, *, most: int | None = None) -> None:
    """Append rows as JSON lines; no more than ``most`` of a batch, the last by ``at``, where it is given."""
    (df if most is None else df.orderBy(F.desc("at")).limit(most)).write.mode("append").json(path)


def shadow_rows(recalled: DataFrame, *, injected: bool = False, head: int = 200) -> DataFrame:
    """Recalls (session, turn, step, query, results, included, skipped, text) as they are logged: sizes, and heads with secrets redacted."""
    cut = lambda c: F.substring(tx.redact(tx.text(c)), 1, head)
    would = tx.text("text") != ""
    return recalled.select("session", "turn", "step", cut("query").alias("query"), F.length(tx.text("query")).alias("query_chars"), "results", would.alias("would_inject"), (would & F.lit(injected)).alias("injected"), F.length(tx.text("text")).alias("chars"), "included", "skipped", cut("text").alias("head"))


def profile_patches(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(profile, path) of the files of a name, one in each profile's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("profile"), "path")


def settings_snippet(values: dict[str, object], plugin_id: str, plugin_name: str, indent: int = 0) -> str:
    """Settings as YAML lines that can be put into a profile's patch."""
    lines = [f"- id: {plugin_id}", f"  name: '{plugin_name}'", "  config:", *(f"    {k}: {v}" for k, v in values.items())]
    return "\n".join(" " * indent + x for x in lines)


def embed(texts: DataFrame, service: Callable[[list[str]], Sequence[Sequence[float]] | None], *, text_col: str = "text", batch: int = 32, tries: int = 4, pause: float = 0.5) -> DataFrame:
    """``texts`` with ``vector``, from an injected service in batches; null for a batch that fails every try."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out: list = []
            for k in range(0, len(series), batch):
                part = series.iloc[k : k + batch].fillna("").tolist()
                found = None
                for attempt in range(tries):
                    try:
                        found = service(part)
                        break
                    except Exception:  # a service's failures are its own; the last one leaves null
                        time.sleep(pause * attempt)
                out += list(found) if found is not None else [None] * len(part)
            yield pd.Series(out, dtype=object)

    return texts.withColumn("vector", vectors(F.col(text_col)))


def compaction_settings(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value): settings within 24 lines after a compaction heading of YAML-like text files, and the defaults where none is set."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    heads = rows.where(F.col("line").rlike(r"^\s*-?\s*compaction\s*:")).groupBy("path").agg(F.min("n").alias("head"))
    near = rows.join(heads, "path").where("n > head AND n <= head + 24")
    key, value = (F.regexp_extract("line", r"^\s+([A-Za-z][\w]*)\s*:\s*([^#\s]+)", k) for k in (1, 2))
    return near.select("path", key.alias("key"), value.alias("value")).where("key <> ''")


def with_defaults(values: Column, defaults: dict[str, str]) -> Column:
    given = F.coalesce(values, F.create_map().cast("map<string,string>"))
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.try_element_at(given, F.lit(k)), F.lit(v)).alias("value")) for k, v in defaults.items()]))


def untouched(values: Column) -> Column:
    """Whether nothing is set, so all defaults hold."""
    return F.coalesce(F.size(values) == 0, F.lit(True))


def session_titles(spark: SparkSession, path: str) -> DataFrame:
    """(path, sid, title, first): titles and first sentences, 200 characters at most, of a projection cache.

    A file is one session's record, whose name is the file's, or a list of records, each with its session's ``sid``.
    """
    docs = spark.read.schema("sid string, record struct<rows: struct<title: struct<val: string>, titleInput: struct<val: struct<first: struct<text: string>>>>>").option("multiLine", "true").json(path)
    return docs.select(F.col("_metadata.file_path").alias("path"), "sid", tx.text(F.col("record.rows.title.val")).alias("title"), F.substring(tx.collapse(F.col("record.rows.titleInput.val.first.text")), 1, 200).alias("first"))
