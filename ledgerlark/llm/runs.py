"""Links inside cells: rows that share a cell are read as a sorted run and compared there.

A crowded cell yields a spanning forest of verified links, not its pairs. A cell of more than
``RUN`` rows is cut in chunks, and every pair of chunks becomes a run of its own, so that no
task holds more than two chunks and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RUN = 4096
_SMALL = 32
Near = Callable[[np.ndarray, object, object], np.ndarray]


def _forest(rows: np.ndarray, near: Near) -> tuple[list[int], list[int]]:
    """Verified links that connect whatever a run's links connect: a search that meets each member once."""
    left, frontier, a, b = np.arange(len(rows)), [], [], []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        node = frontier.pop()
        hit = near(rows, left, node)
        found = left[hit]
        a += [node] * len(found)
        b += found.tolist()
        frontier += found.tolist()
        left = left[~hit]
    return a, b


def run_links(cell: np.ndarray, ids: np.ndarray, rows: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``cell``: all of a short run, a forest of a longer one."""
    if not len(ids):
        return ids, ids
    lead = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(lead, len(cell)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(np.repeat(size <= _SMALL, size))
    stop = np.repeat(lead + size, size)
    for step in range(1, _SMALL):
        at = at[at + step < stop[at]]
        if not len(at):
            break
        hit = at[near(rows, at, at + step)]
        left.append(hit)
        right.append(hit + step)
    for begin, n in zip(lead[size > _SMALL], size[size > _SMALL], strict=True):
        a, b = _forest(rows[begin : begin + n], near)
        left.append(np.asarray(a, np.int64) + begin)
        right.append(np.asarray(b, np.int64) + begin)
    return ids[np.concatenate(left)], ids[np.concatenate(right)]


def _search(load: Callable[[pa.RecordBatch], np.ndarray], near: Near, limit: int | None):
    """Over rows sorted by cell: links (a, b, null); of a cell over ``limit`` its members (id, chunk, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = ids = rows = None
        crowded, chunk = None, 0

        def links(stop: int) -> pa.RecordBatch:
            a, b = run_links(cell[:stop], ids[:stop], rows[:stop], near)
            return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "cell"])

        def members(begin: int, n: int, chunk: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array(ids[begin : begin + n]), pa.array(np.full(n, chunk)), pa.array(cell[begin : begin + n])], names=["a", "b", "cell"])

        for batch in batches:
            new = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("cell", "id")] + [load(batch)]
            cell, ids, rows = new if cell is None else (np.concatenate(x) for x in zip((cell, ids, rows), new, strict=True))
            if not len(cell):
                continue
            keep = np.ones(len(cell), bool)
            if crowded is not None:
                n, begin = int(np.searchsorted(cell, crowded, "right")), 0
                while n >= RUN or (n and begin + n < len(cell)):
                    take = min(n, RUN)
                    yield members(begin, take, chunk)
                    keep[begin : begin + take] = False
                    begin, n, chunk = begin + take, n - take, chunk + 1
                if begin + n < len(cell):
                    crowded, chunk = None, 0
            if limit is not None:
                lead = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                size = np.diff(np.append(lead, len(cell)))
                for begin, n in zip(lead[size > limit].tolist(), size[size > limit].tolist(), strict=True):
                    if not keep[begin]:
                        continue
                    ended, part = begin + n < len(cell), 0
                    while n >= RUN or (n and ended):
                        take = min(n, RUN)
                        yield members(begin, take, part)
                        keep[begin : begin + take] = False
                        begin, n, part = begin + take, n - take, part + 1
                    if not ended:
                        crowded, chunk = cell[-1], part
            cell, ids, rows = cell[keep], ids[keep], rows[keep]
            if len(cell):
                cut = int(np.searchsorted(cell, cell[-1] if crowded is None else crowded, "left"))
                yield links(cut)
                cell, ids, rows = cell[cut:], ids[cut:], rows[cut:]
        if cell is not None and len(cell):
            yield members(0, len(cell), chunk) if crowded is not None else links(len(cell))

    return run


def linked(cells: DataFrame, load: Callable[[pa.RecordBatch], np.ndarray], near: Near) -> DataFrame:
    """Links (a, b) of ids among rows (cell, id, ...) that share a cell and that ``near`` accepts.

    ``load`` turns a batch into the rows that ``near(rows, i, j)`` compares. All links of thin
    cells are given, and of crowded cells enough of them to connect what they connect.
    """
    schema = "a long, b long, cell long"
    found = materialize(cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_search(load, near, RUN), schema), "cells")
    thin = found.where("cell is null").select("a", "b")
    crowded = found.where("cell is not null")
    if crowded.isEmpty():
        return thin
    chunks = crowded.groupBy("cell").agg((F.max("b") + 1).alias("n"))
    paired = crowded.join(chunks.hint("merge"), "cell").select("cell", F.col("a").alias("id"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    runs = paired.select(F.xxhash64("cell", F.least("b", "other"), F.greatest("b", "other")).alias("run"), "cell", "id")
    rest = [c for c in cells.columns if c not in ("cell", "id")]
    if rest:
        runs = runs.join(cells.hint("merge"), ["cell", "id"])
    runs = runs.select(F.col("run").alias("cell"), "id", *rest)
    dense = runs.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_search(load, near, None), schema)
    return thin.union(dense.select("a", "b"))
