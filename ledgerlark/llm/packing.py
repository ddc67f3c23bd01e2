"""Best-fit packing by patterns of few documents, fitted by non-negative least squares.

The histogram of piece lengths has at most ``capacity`` bars, however many documents there
are. Patterns are the ways to fill a sequence wholly with one, two or three pieces; the number
of times each is used is fitted to the histogram by non-negative least squares, rounded so
that no length is used up twice, and what remains is packed best-fit decreasing, still by
length. The plan tells, for each length, which ranks go where; every piece then finds its
sequence and offset by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import gapless_rank, materialize, small_batches, text_slices

_ROUNDS = 200
_PORTIONS = 64


def _piece_rows(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, None)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            owners = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, _, _ in text_slices(batch):
                ids, sizes = coder.encode(texts[lo:hi].to_pylist())
                rows, at = [], 0
                for i, size in enumerate(sizes.tolist()):
                    whole = np.append(ids[at : at + size], end_id).astype("<u4")
                    at += size
                    begin, n = 0, len(whole)
                    length = n % capacity or capacity
                    piece = 0
                    while begin < n:
                        part = whole[begin : begin + length]
                        rows.append((i, piece, begin, len(part), zlib.crc32(part.tobytes())))
                        begin, length, piece = begin + length, capacity, piece + 1
                owner, piece, begin, length, crc = (np.array(x) for x in zip(*rows, strict=True))
                yield pa.record_batch(
                    [owners[lo:hi].take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its ids and ``end_id``; only a longer one is cut, and its first piece may be shorter.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_piece_rows(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the plan --------------------------------------------------------------


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill ``capacity`` with one to three lengths that occur; rows ascending, zero where unused."""
    found = [np.array([[0, 0, capacity]])] if present[capacity] else []
    have = np.flatnonzero(present)
    pairs = have[(have * 2 <= capacity) & present[capacity - have]]
    found.append(np.stack([np.zeros_like(pairs), pairs, capacity - pairs], 1))
    for a in have[have * 3 <= capacity]:
        b = have[(have >= a) & (have * 2 <= capacity - a)]
        b = b[present[capacity - a - b]]
        found.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(found)


def fit(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x with least squares of A x against the histogram, by multiplicative updates."""
    target = histogram.astype(float)
    target[0] = 0
    gather = lambda v: v[rows].sum(1)
    x = target[rows].max(1) / np.maximum(np.bincount(rows.max(1), minlength=len(target))[rows.max(1)], 1)
    up = gather(target)
    for _ in range(_ROUNDS):
        made = sum(np.bincount(rows[:, k], x, len(target)) for k in range(3))
        made[0] = 0
        x *= up / np.maximum(gather(made), 1e-12)
    return x


class Plan:
    """Slots (length, first rank, count, first sequence, offset) and the number of sequences."""

    def __init__(self, histogram: np.ndarray) -> None:
        self.capacity, self.sequences = len(histogram) - 1, 0
        left, self._used, self._slots = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64), []
        self._fit(left)
        self._best_fit(left)
        slots = np.array(sorted(self._slots), np.int64).reshape(-1, 5)
        self.lengths, self.ranks, self.counts, self.bases, self.offsets = slots.T

    def _put(self, length: int, count: int, base: int, offset: int) -> None:
        self._slots.append((length, int(self._used[length]), count, base, offset))
        self._used[length] += count

    def _fit(self, left: np.ndarray) -> None:
        rows = patterns(left > 0, self.capacity)
        if not len(rows):
            return
        x = fit(rows, left)
        order = np.lexsort((rows[:, 0], rows[:, 1], rows[:, 2]))
        # Repeats are handed out in portions, so that the plan stays some tens of patterns a length.
        portion = np.maximum(1, left // _PORTIONS).tolist()
        carry = 0.0
        remaining = left.tolist()
        for (a, b, c), want in zip(rows[order].tolist(), x[order].tolist(), strict=True):
            carry += want
            if carry < portion[c]:
                continue
            n = int(carry)
            carry -= n
            need: dict[int, int] = {}
            for length in (a, b, c):
                if length:
                    need[length] = need.get(length, 0) + 1
            n = min(n, *(remaining[k] // m for k, m in need.items()))
            if n <= 0:
                continue
            offset = 0
            for length in (c, b, a):
                if length:
                    self._put(length, n, self.sequences, offset)
                    remaining[length] -= n
                    offset += length
            self.sequences += n
        left[:] = remaining

    def _best_fit(self, left: np.ndarray) -> None:
        """Best-fit decreasing over counts: sequences with equal room stand together as ranges."""
        room: dict[int, list[tuple[int, int]]] = {}
        sizes: list[int] = []

        def add(space: int, base: int, count: int) -> None:
            if space:
                if space not in room:
                    room[space] = []
                    insort(sizes, space)
                room[space].append((base, count))

        for length in range(self.capacity, 0, -1):
            n = int(left[length])
            while n:
                at = bisect_left(sizes, length)
                if at == len(sizes):
                    each = self.capacity // length
                    full = max(1, n // each)
                    add(self.capacity, self.sequences, full)
                    self.sequences += full
                    continue
                space = sizes[at]
                base, count = room[space].pop()
                if not room[space]:
                    del room[space]
                    sizes.pop(at)
                take = min(n, count)
                if take < count:
                    add(space, base + take, count - take)
                self._put(length, take, base, self.capacity - space)
                add(space - length, base, take)
                n -= take
        left[:] = 0


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, bases, offsets = shared.value
        key = (lengths << np.int64(40)) + ranks
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            slot = np.searchsorted(key, (length << np.int64(40)) + rank, "right") - 1
            sequence = bases[slot] + rank - ranks[slot]
            cols = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            yield pa.record_batch([*cols, pa.array(sequence), pa.array(offsets[slot])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece; offsets
    are gapless from 0 in each sequence. Needs doc_id and text; other columns are ignored. A null
    or empty text is the end id alone; a null doc_id stays null; repeated rows are packed as often
    as they occur; an empty table gives an empty result. The driver holds the histogram and the
    plan, both bounded by ``capacity`` and not by the documents.
    """
    cut = materialize(pieces(docs, path, capacity, end_id), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    plan = Plan(histogram)
    # The plan is bounded by the capacity: at most three slots for each of _PORTIONS patterns a length, and the rest's ranges.
    shared = docs.sparkSession.sparkContext.broadcast((plan.lengths, plan.ranks, plan.bases, plan.offsets))
    salts = int(min(65536, max(64, histogram.sum() // 20000)))
    ranked = gapless_rank(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank", salts)
    return ranked.mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset, 2048 tokens a sequence.

    A null or empty text is one piece of its closing token; repeated rows, and rows without an id, are each packed; other columns are
    ignored; an empty table gives no rows.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


__all__ = ["Plan", "fit", "op2_best_fit_packing", "pack", "patterns", "pieces"]
