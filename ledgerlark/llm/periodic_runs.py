"""Periodic runs of words: multi-scale minimizers seed extension, short periods are scanned lag by lag.

A run is a longest stretch of words in which words q apart are identical, of at least
max(``least``, ``times`` * q) words, with q its smallest period.

* Periods up to ``SHORT`` are found directly: for each lag, the stretches where a word equals
  the one that many places on.
* Longer ones are looked for by scale. The scale k covers periods in (k/2, k]. A position is a
  minimizer if the hash of its k words is the least of some k/2 neighbouring positions. A run of four
  periods holds two whole such windows one period apart, so their minimizers stand one period apart
  too; and as k words tell apart all rotations of a period of at most k, no minimizer between
  them has the same hash. So each run shows as two neighbours in the list of minimizers sorted by hash and
  place. Such a pair is extended to both sides, and what reaches the asked length is compared word by word.

Minimizers thin out as k grows and texts too short for a scale leave it, so the work is nearly linear
in the words. Each text is searched by itself, inside one task: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _powers, mix, small_batches, span_index, text_slices, word_bounds, word_hashes

SHORT = 8
_LEFT, _RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_TOP = np.uint64(2**64 - 1)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of true begin and end."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(words: np.ndarray, doc: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every stretch whose words equal those ``lag`` places on."""
    begin, end = _stretches((words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag]))
    return begin, end - begin + lag


def _sliding(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, from running values inside blocks of that width."""
    n = len(a)
    blocks = np.concatenate([a, np.full(-n % width, a[-1])]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def _minimizers(h: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
    """Positions whose hash of k words is the least of some k/2 neighbours; all k words lie in one text."""
    width, at = k // 2, np.arange(len(h))
    whole = at + k <= stop
    h = np.where(whole, np.minimum(np.maximum(h, np.uint64(1)), _TOP - np.uint64(1)), _TOP)
    low = _sliding(h, width, np.minimum)
    low[at[: len(low)] + width + k - 1 > stop[: len(low)]] = 0
    edge = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    return np.flatnonzero((reach == h) & whole)


def _agreement(total: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from i and from j on (``step`` 1) or before them (-1) agree, at most ``limit``: binary search over range hashes."""
    inverse = _powers(len(total))[1]
    low, high = np.zeros(len(i), np.int64), limit.copy()
    while (low < high).any():
        half = (low + high + 1) // 2
        a, b = (i, j) if step > 0 else (i - half, j - half)
        same = (total[a + half] - total[a]) * inverse[a] == (total[b + half] - total[b]) * inverse[b]
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _seeded(words: np.ndarray, h: np.ndarray, begin: np.ndarray, stop: np.ndarray, k: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of stretches with periods in (k/2, k] of at least ``times`` periods."""
    at = _minimizers(h, stop, k)
    order = np.argsort(h[at], kind="stable")
    i, j = at[order][:-1], at[order][1:]
    lag = j - i
    pair = (h[i] == h[j]) & (stop[i] == stop[j]) & (lag > k // 2) & (lag <= k)
    i, j, lag = i[pair], j[pair], lag[pair]
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * _powers(len(words) + 1)[0][: len(words)], out=total[1:])
    right = _agreement(total, i, j, stop[i] - j, 1)
    left = _agreement(total, i, j, i - begin[i], -1)
    length = left + right + lag
    long = length >= times * lag
    found = np.unique(np.stack([(i - left)[long], length[long], lag[long]]), axis=1)
    # Word by word: range hashes only proposed the ends.
    start, length, lag = found
    at = span_index(start, length - lag)
    same = words[at] == words[at + np.repeat(lag, length - lag)]
    wrong = np.zeros(len(start), np.int64)
    np.add.at(wrong, np.repeat(np.arange(len(start)), length - lag)[~same], 1)
    return start[wrong == 0], length[wrong == 0], lag[wrong == 0]


def find_runs(words: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (a word number of the buffer), length and period of every run, by start, then period.

    ``words`` are word hashes of several texts; text d has those from first[d] to first[d + 1].
    """
    if times < 4:
        raise ValueError("windows of the scales need four periods")
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    parts = []
    for lag in range(1, SHORT + 1):
        if len(words) > lag:
            start, length = _scan(words, doc, lag)
            keep = length >= max(least, times * lag)
            parts.append((start[keep], length[keep], np.full(keep.sum(), lag)))
    place, begin, stop, k, h = np.arange(len(words)), np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes), 1, words
    while len(h):
        # k words become 2k; texts that cannot hold four periods of more than k leave.
        h = np.concatenate([mix(h[:-k] * _LEFT + h[k:] * _RIGHT), np.zeros(min(k, len(h)), np.uint64)])
        k *= 2
        stay = stop - begin >= max(2 * k + 4, 4 * SHORT + 4)
        if not stay.all():
            shift = np.cumsum(~stay)[stay]
            words, h, place, begin, stop = words[stay], h[stay], place[stay], begin[stay] - shift, stop[stay] - shift
        if k > SHORT and len(h):
            start, length, lag = _seeded(words, h, begin, stop, k, times)
            keep = (lag > SHORT) & (length >= least)
            parts.append((place[start[keep]], length[keep], lag[keep]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    start, length, lag = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    # The same stretch under a multiple of its period is the same run.
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    order = np.lexsort((lag[new], start[new]))
    return start[new][order], length[new][order], lag[new][order]


def repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """For each of n words, whether some run holds it after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _collapsed(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> pa.Array:
    """The words from begin to end of each text, joined by one space; any two words of a text have white space between them."""
    edge = np.zeros(len(data) + 2, np.int8)
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    edge[begin] += 1
    np.subtract.at(edge, end + ~last, 1)
    kept = np.cumsum(edge, dtype=np.int8)[: len(data)] > 0
    out = data.copy()
    out[end[~last]] = 32
    size = np.concatenate([[0], np.cumsum(kept)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer((size - size[0]).astype(np.int64)), pa.py_buffer(out[kept])).cast(pa.string())


def _rows(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.column(batch.schema.get_field_index("carried"))
            for lo, hi, data, offsets in text_slices(batch):
                begin, end, first = word_bounds(data, offsets)
                words, doc = word_hashes(data, begin, end), np.repeat(np.arange(hi - lo), np.diff(first))
                start, length, period = find_runs(words, first, least, times)
                keep = ~repeats(len(words), start, length, period)
                owner = doc[start]
                columns = [start - first[owner], length, period]
                runs = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32)
                collapsed = _collapsed(data, offsets, begin[keep], end[keep], doc[keep])
                lists = pa.ListArray.from_arrays(pa.array(edges), runs)
                yield pa.record_batch([carried[lo:hi], pa.array(np.diff(first).astype(np.int64)), lists, collapsed], names=["carried", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(carried, n_words, runs, collapsed) for every row; carried is a struct of all columns but text.

    ``runs`` are (start, length, period) in words, by start, then period. ``collapsed`` has the words that
    no run repeats, joined by one space. A null, empty or blank text has no words, no runs and
    an empty collapsed text; repeated rows each give their own; an empty table gives no rows; columns of ``docs``
    may have any names, as they are carried in a struct. ``times`` is 4 or more.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), F.col("text").cast("string").alias("text"))
    kind = flat.schema["carried"].dataType.simpleString()
    return flat.mapInArrow(_rows(least, times), f"carried {kind}, n_words long, runs {RUNS}, collapsed string")


def with_period(text: Column, doc_id: Column) -> Column:
    """The text of a tenth of the documents made periodic from some word on, as the contract of op11 fixes it; the others as they are.

    A null id makes nothing periodic.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    periods = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(periods, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs in every document, the longest of them, and the text without their repeats.

    A null or empty text has no runs, nulls for the longest and the digests of the empty string. Repeated rows
    each give a row; an empty table gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", with_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    # The greatest of (length, -start, -period) is the longest run, ties to the smallest start, then period.
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    top = found.select("carried.doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), F.array_max(ranked).alias("top"), lines.alias("lines"), "collapsed")
    return top.select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(F.expr("1000 * top.length div -top.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


__all__ = ["find_runs", "op11_periodic_runs", "periodic_runs", "repeats", "with_period"]
