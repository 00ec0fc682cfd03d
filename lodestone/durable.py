"""Tables in the folder that all executors share; writing one cuts lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on one machine, where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/lodestone-shared"
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._table_path = path
    return found


def _located(df: DataFrame):
    """(file system, path) of a table that ``table`` has written, or None."""
    path, session = getattr(df, "_table_path", None), df.sparkSession
    if not path or not hasattr(session, "_jvm"):
        return None
    where = session._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(session._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Delete tables that nothing needs any more: whatever was made of them has been written in its turn."""
    for df in tables:
        if found := _located(df):
            found[0].delete(found[1], True)


def is_there(df: DataFrame) -> bool:
    """Whether a written table still exists, so far as that can be told."""
    found = _located(df)
    return found is None or found[0].exists(found[1])
