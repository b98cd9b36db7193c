"""Places on the shared file system for tables that are written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset (a local session, as in tests) is a
    temporary folder taken and set as the checkpoint folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage with a copy that every executor can read, so a lost executor costs no more
    than its running tasks.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of settled tables that nothing reads any more: what was made from them is written itself."""
    for table in tables:
        session = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never sent through the driver.

    Spark guesses a table's size from its compressed files and takes a row of an Arrow function or an explode for one row
    of its input, so rows a hundred times the limit of a broadcast may pass for less.
    """
    return df.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once.

    The optimizer may copy an expression to where it is used, which inside a lambda function means once
    per element, and pushes filters below it in the same way. A generator of one row stops both.
    """
    whole = F.struct(*(c.alias(name) for name, c in columns.items()))
    kept = df.select("*", F.explode_outer(F.array(whole)).alias("_held"))
    return kept.select(*df.columns, *(F.col(f"_held.{name}").alias(name) for name in columns))


def packed_rows(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and ``_row``, a struct of all columns, so that no other column's name can clash with ours."""
    return df.select(*needed, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def unpacked(df: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``like`` from ``_row``, some replaced."""
    return df.select(*((replaced[c] if c in replaced else F.col("_row").getField(c)).alias(c) for c in like.columns))
