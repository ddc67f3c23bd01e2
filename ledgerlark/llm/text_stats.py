"""Word, symbol, line and repetition counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, gram_hashes, mix, range_hashes, small_batches, text_slices, word_bounds, word_hashes
from .common import _BYTE as BYTE_VALUES

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[offsets])


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of NAMES for the texts in a buffer."""
    docs = np.arange(len(offsets) - 1)
    start, end, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    inside = ~_SPACE[data]
    word_chars = _per_text(inside & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_text(_SYMBOL[data], offsets)

    cuts = np.flatnonzero(data == 10)
    doc_of_cut = np.searchsorted(offsets, cuts, "right") - 1
    begins = np.concatenate([offsets[:-1], cuts + 1])
    line_doc = np.concatenate([docs, doc_of_cut])
    order = np.lexsort((begins, line_doc))
    begins, line_doc = begins[order], line_doc[order]
    ends = np.concatenate([begins[1:], offsets[-1:]]) if len(begins) else begins
    last = np.append(line_doc[1:] != line_doc[:-1], True)[: len(begins)]
    ends = np.where(last, offsets[line_doc + 1], ends - 1)
    seen = np.concatenate([[0], np.cumsum(inside)])
    worded = seen[ends] > seen[begins]
    begins, ends, line_doc = begins[worded], ends[worded], line_doc[worded]
    lines = _own(range_hashes(BYTE_VALUES[data], begins, ends) + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), line_doc)
    _, at = np.unique(lines, return_index=True)
    n_dup = np.bincount(line_doc, minlength=len(docs)) - np.bincount(line_doc[at], minlength=len(docs))

    doc_of_word = np.repeat(docs, n_words)
    grams = gram_hashes(word_hashes(data, start, end), 3)
    whole = doc_of_word[: len(grams)] == doc_of_word[2:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    again = np.zeros(len(start) + 1, np.int32)
    if len(at):
        _, which, times = np.unique(_own(grams[at], doc_of_word[at]), return_inverse=True, return_counts=True)
        at = at[times[which] > 1]
        np.add.at(again, at, 1)
        np.add.at(again, np.minimum(at + 3, len(start)), -1)
    n_repeat = _per_text(np.cumsum(again)[:-1] > 0, first)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        carried = batch.column(batch.schema.get_field_index("carried"))
        for lo, hi, data, offsets in text_slices(batch):
            columns = counts(data, offsets)
            yield pa.record_batch([carried[lo:hi], *(pa.array(c.astype(np.int64)) for c in columns)], names=["carried", *NAMES])


def text_stats(docs: DataFrame) -> DataFrame:
    """(carried, the columns of NAMES) for every row; carried is a struct of all columns but text.

    A null or empty text has zero of everything.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), F.col("text").cast("string").alias("text"))
    kind = flat.schema["carried"].dataType.simpleString()
    return flat.mapInArrow(_rows, f"carried {kind}, " + ", ".join(f"{n} long" for n in NAMES))
