"""Helpers that the corpus operators share: scratch tables, text buffers, word hashes, gapless ranks.

The numpy helpers work on one slice of an Arrow batch at a time (about one MB of
text, or one document if it is longer), so their memory does not grow with the input.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Stands for a null id inside the operators; results keep the null.
NULL_ID = -(2**63)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    A local session that names none, as in tests, gets a temporary folder; on a cluster executors
    would each write to their own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long rows: send Python fewer of them at once than Spark does by default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: lineage ends there and sizes are known."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(column: str = "doc_id") -> Column:
    """The id as a long that is never null, so that joins on it keep every row."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) of a batch with their bytes and the offsets of each text in them; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# ---- words -----------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word [^\\x20\\x09-\\x0D]+, and the number of the first word of each text (one more at the end)."""
    inside = ~_SPACE[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = inside[first]
    final = offsets[1:][offsets[1:] > 0] - 1
    last[final] = inside[final]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place on its own copy."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one prefix sum over all bytes."""
    return mix(range_hashes(_BYTE[data], start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2**64 of each range [start, end) of random 64-bit values."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[end] - total[start]) * inverse[start]


_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words (also across texts: callers mask those)."""
    size = max(0, len(words) - n + 1)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h += words[j : j + size] * _ODD[j % 64]
    return mix(h)


def double(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The hash of 2 * length words at the places, from the hashes of length words."""
    return mix(h[at] * _ODD[1] + h[at + length] * _ODD[2])


def span_index(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... count[0] numbers, then the same for each other pair."""
    if not len(begin):
        return np.zeros(0, np.int64)
    skip = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(begin - skip, count)


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# ---- ranks -----------------------------------------------------------------


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, salts: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, and without gathering a group in one task.

    A group is dealt over ``salts`` parts by the hash of ``order``; each part is numbered
    by itself, and a part's offset is the count of the parts before it. The table of counts
    has at most ``salts`` rows a group. ``order`` must name a row, or its ties be alike.
    """
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(c).alias(f"_g_{c}") for c in group), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(inner) - 1)
    on = F.col("_salt") == F.col("_s")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = numbered.join(offsets.hint("merge"), on)
    return joined.select(*df.columns, (F.col("_row") + F.col("_before")).cast("long").alias(name))
