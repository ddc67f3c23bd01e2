"""Written intermediate tables: in the folder that all executors share, each built once a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUILT: dict[tuple, tuple[str, str, StructType]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written and read again: its plan ends there, and its size is known."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_state(spark: SparkSession, paths: list[str]) -> str:
    """A name of the files under some paths as they are now: their places, lengths and times of change. No content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    n, size, mark = listed.select(F.col("length"), one.alias("h")).agg(F.count(F.lit(1)), F.sum("length"), F.sum("h")).first()
    return f"{n}-{size}-{mark}"


def built_once(spark: SparkSession, key: tuple, state: str, build: Callable[[], DataFrame], codec: str = "snappy") -> DataFrame:
    """The written table of ``build``, made at its first use in a session and again when its inputs have changed.

    ``key`` names the table, ``state`` its inputs (see ``files_state``). A table that is made again
    leaves the one before it empty, so that it no longer takes room.
    """
    key = (spark.sparkContext.applicationId, *key)
    before = _BUILT.get(key)
    if before and before[0] == state:
        try:
            return spark.read.schema(before[2]).parquet(before[1])
        except AnalysisException:
            before = None  # the folder was cleared
    df, path = build(), scratch_path(spark, str(key[1]))
    df.write.parquet(path, compression=codec)
    _BUILT[key] = state, path, df.schema
    if before:
        spark.createDataFrame([], before[2]).write.mode("overwrite").parquet(before[1])
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows
