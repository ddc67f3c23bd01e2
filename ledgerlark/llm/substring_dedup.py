"""Substring dedup by level-wise doubling.

Windows of words that repeat at one length are the only ones extended to twice that
length, until the asked length is reached: 5, 10 and 20 words for windows of 20.

* Level 1 looks at the windows of window/4 words that hold the least hash among those of
  some whole window (about one word in nine). Equal whole windows share that place, so
  none is lost, and a ninth of the rows is shuffled.
* Level 2 extends each surviving place to the right and to the left; a whole window
  around it contains one of the two. It also looks at the stretch that all whole windows
  around the place cover: where an equal stretch starts earlier, all its windows do, and
  they are settled there. The first start of any window is in no settled stretch.
* Level 3 extends to every other whole window around a survivor and finds its first start.

Each task sends a hash once for a block of its rows, so a passage that a third of the
documents share reaches a reducer as often as there are blocks, not documents. Reducers
sort by hash and read runs of equal hashes as a stream. No level gathers all places of a
passage, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, double, gram_hashes, materialize, mix, range_hashes, small_batches, span_index, text_slices, word_bounds, word_hashes

_BLOCK = 1 << 19
_SENT = "key long, chk int, dk long, pos int, flag int"
#: Kinds of rows: a window, one that its block repeats, a stretch around an anchor, and what a block settles alone.
WINDOW, REPEATED, CONTEXT, SETTLED, SETTLED_CONTEXT = 0, 1, 2, 3, 4


def _words(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, the first word of each text, and for each word the end of its text."""
    start, end, first = word_bounds(data, offsets)
    return word_hashes(data, start, end), first, np.repeat(first[1:], np.diff(first))


def _least(a: np.ndarray, m: int, pick) -> np.ndarray:
    width = 1
    while width * 2 <= m:
        a = pick(a[:-width], a[width:])
        width *= 2
    return pick(a[: len(a) - (m - width)], a[m - width :]) if m > width else a


def _anchors(h: np.ndarray, stop: np.ndarray, base: int, window: int) -> np.ndarray:
    """Places whose hash is the least among the base windows of some whole window."""
    m, n = window - base + 1, len(h)
    if n < m:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    h = np.where(at + base <= stop[:n], np.maximum(h, np.uint64(1)), np.uint64(2**64 - 1))
    low = _least(h, m, np.minimum)
    low[at[: len(low)] + window > stop[: len(low)]] = 0
    edge = np.zeros(m - 1, np.uint64)
    reach = _least(np.concatenate([edge, low, edge]), m, np.maximum)
    return np.flatnonzero((reach == h) & (reach > 0) & (at + base <= stop[:n]))


def _owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, "right") - 1


class _Block:
    """Rows of one task until they are many; then each hash once, and what the block alone settles."""

    def __init__(self, final: bool) -> None:
        self.final, self.parts, self.rows = final, [], 0

    def add(self, h: np.ndarray, chk: np.ndarray, dk: np.ndarray, pos: np.ndarray, kind: int) -> None:
        if len(h):
            self.parts.append((h.view(np.int64), chk, dk, pos, np.full(len(h), kind, np.int32)))
            self.rows += len(h)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        key, chk, dk, pos, flag = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.lexsort((pos, dk, chk, key, flag))
        lead, size = _runs(flag[order], key[order], chk[order])
        first = np.repeat(order[lead], size)
        later = np.zeros(len(key), bool)
        later[order] = (dk[order] != dk[first]) | (pos[order] != pos[first])
        keep = later.copy()
        keep[order[lead]] = True
        keep |= flag == SETTLED
        if not self.final:
            again = order[lead[(size > 1) & (flag[order[lead]] == WINDOW)]]
            flag[again] = REPEATED
        later &= flag != SETTLED
        flag[later & (flag == CONTEXT)] = SETTLED_CONTEXT
        flag[later & (flag == WINDOW)] = SETTLED
        chk[later] = 1
        settled = flag >= SETTLED
        key[settled] = mix(dk[settled].view(np.uint64) ^ np.uint64(0xA5A5)).view(np.int64)
        kept = (x[keep] for x in (key, chk, dk, pos, flag))
        yield pa.record_batch([pa.array(x) for x in kept], names=["key", "chk", "dk", "pos", "flag"])


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of rows with equal columns begin, and their sizes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    lead = np.flatnonzero(new)
    return lead, np.diff(np.append(lead, len(new)))


def _places(batch: pa.RecordBatch, lo: int, hi: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The surviving places of the texts in a slice, as word numbers there, and the anchors whose stretch is settled."""
    places = batch.column(batch.schema.get_field_index("places"))[lo:hi]
    at = np.asarray(places.flatten()).astype(np.int64)
    base = np.repeat(first[:-1], np.diff(np.asarray(places.offsets)))
    return (at + base)[at >= 0], (-1 - at + base)[at < 0]


def _stretch_hashes(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words [low, high) around each anchor, and of the anchor's place among them."""
    shape = (at - low).astype(np.uint64) * np.uint64(1 << 20) + (high - low).astype(np.uint64)
    return tuple(mix(range_hashes(x, low, high) + shape * np.uint64(0x9FB21C651E98DF25)) for x in (words, mix(words ^ np.uint64(0x5BD1E995))))


def _emit(level: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    base = window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(level == 3)
        for batch in batches:
            ids = np.asarray(batch.column(batch.schema.get_field_index("dk")))
            for lo, hi, data, offsets in text_slices(batch):
                words, first, stop = _words(data, offsets)
                if len(words) < window:
                    continue

                def add(h, chk, at, kind, first=first, own=ids[lo:hi]):
                    doc = _owner(first, at)
                    block.add(h, chk, own[doc], (at - first[doc]).astype(np.int32), kind)

                h = gram_hashes(words, base)
                if level == 1:
                    at = _anchors(h, stop, base, window)
                    add(h[at], np.zeros(len(at), np.int32), at, WINDOW)
                else:
                    begin = np.repeat(first[:-1], np.diff(first))
                    at, settled = _places(batch, lo, hi, first)
                if level == 2:
                    at = np.unique(at)
                    long, check = _stretch_hashes(words, at, np.maximum(at - (window - base), begin[at]), np.minimum(at + window, stop[at]))
                    add(long, (check >> np.uint64(32)).astype(np.uint32).view(np.int32), at, CONTEXT)
                    at = np.unique(np.concatenate([at, (at - base)[at - base >= begin[at]]]))
                    at = at[at + 2 * base <= stop[at]]
                    add(double(h, at, base), np.zeros(len(at), np.int32), at, WINDOW)
                elif level == 3:
                    low, edge = np.maximum(settled - (window - base), begin[settled]), np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, np.minimum(settled, stop[settled] - window) + 1, -1)
                    done = np.cumsum(edge[:-1]) > 0
                    lead, size = _runs(done, begin)
                    size, lead = size[done[lead]], lead[done[lead]]
                    add(np.zeros(len(lead), np.uint64), size.astype(np.int32), lead, SETTLED)
                    low = np.maximum(at - 2 * base, begin[at])
                    at = np.unique(span_index(low, at - low + 1))
                    at = at[(at + window <= stop[at]) & ~done[at]]
                    half = double(h, np.arange(max(0, len(h) - base)), base)
                    chk = (mix(half[at] * np.uint64(0x9FB21C651E98DF25) ^ half[at + 2 * base]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    add(double(half, at, 2 * base), chk, at, WINDOW)
                if block.rows >= _BLOCK:
                    yield from block.flush()
        yield from block.flush()

    return run


def _judge(final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Read rows sorted by hash, and give places: of windows that repeat or, at the end, of those that are not the first of their hash.

    A settled stretch is given as -1 minus its anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None

        def judged(cols, extra):
            key, chk, dk, pos, flag = cols
            lead, size = _runs(key, chk, flag == CONTEXT)
            own = np.repeat(lead, size)
            later = (dk != dk[own]) | (pos != pos[own])
            window = flag != CONTEXT
            hit = window & (later if final else (np.repeat(size, size) > 1) | (flag == REPEATED))
            stretch = ~window & later
            out = [np.concatenate([x[hit], x[stretch], y]) for x, y in ((dk, extra[2]), (pos, extra[3]))]
            out[1][hit.sum() : hit.sum() + stretch.sum()] *= -1
            out[1][hit.sum() : hit.sum() + stretch.sum()] -= 1
            back = np.flatnonzero(extra[4] == SETTLED_CONTEXT) + int(hit.sum() + stretch.sum())
            out[1][back] = -1 - out[1][back]
            n = np.concatenate([np.ones(int(hit.sum() + stretch.sum()), np.int32), extra[1]])
            return pa.record_batch([pa.array(out[0]), pa.array(out[1]), pa.array(n)], names=["dk", "pos", "n"])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            settled = cols[4] >= SETTLED
            extra, cols = [c[settled] for c in cols], [c[~settled] for c in cols]
            if tail is not None:
                cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            tail = [c[cut:] for c in cols]
            yield judged([c[:cut] for c in cols], extra)
        if tail is not None:
            yield judged(tail, [x[:0] for x in tail])

    return run


def _survivors(sent: DataFrame, final: bool) -> DataFrame:
    rows = sent.repartition("key").sortWithinPartitions("key", "chk", "dk", "pos").mapInArrow(_judge(final), "dk long, pos int, n int")
    if final:
        return rows.groupBy("dk").agg(F.collect_list("pos").alias("places"), F.collect_list("n").alias("counts"))
    return rows.groupBy("dk").agg(F.collect_list("pos").alias("places"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            places, counts = (batch.column(batch.schema.get_field_index(x)) for x in ("places", "counts"))
            kept_text, n_words, n_removed = [], [], []
            for text, at, n in zip(texts, places, counts, strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if at.is_valid:
                    edge = np.zeros(len(words) + window + 1, np.int32)
                    starts = np.asarray(at.values)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + np.asarray(n.values) + window - 1, -1)
                    stays = np.flatnonzero(np.cumsum(edge)[: len(words)] == 0)
                    gone = len(words) - len(stays)
                    words = [words[i] for i in stays]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept_text.append(b" ".join(words).decode())
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index("carried")), texts, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string())],
                names=["carried", "text", "n_words", "n_removed", "kept_text"],
            )

    return run


def cut_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove each word inside a window of ``window`` words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document; windows are judged
    on the input. ``docs`` needs doc_id and text; other columns, whatever their names, come back
    in the struct ``carried`` (with doc_id). Returns carried, text, n_words, n_removed,
    kept_text (the kept words joined by one space).

    A null text has no words; a text with fewer than ``window`` words loses none; a null doc_id
    counts as smaller than any other. Rows that repeat a doc_id and its text are one document:
    each gets the same result and none counts as a copy of the other. Rows that share a doc_id, or
    have none, but differ in their texts are documents of their own, in the order of a hash of
    their text. An empty table gives an empty result. ``window`` must be a multiple of 4.
    """
    small_batches(docs.sparkSession)
    if window % 4 or window <= 0:
        raise ValueError("window must be a positive multiple of 4")
    rest = [c for c in docs.columns if c != "text"]
    flat = _numbered(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried")))
    texts = flat.repartition("dk")
    level1 = _survivors(flat.select("dk", "text").mapInArrow(_emit(1, window), _SENT), False)
    level2 = _survivors(texts.join(level1.hint("merge"), "dk").mapInArrow(_emit(2, window), _SENT), False)
    last = _survivors(texts.join(level2.hint("merge"), "dk").mapInArrow(_emit(3, window), _SENT), True)
    kind = flat.schema["carried"].dataType.simpleString()
    out = f"carried {kind}, text string, n_words long, n_removed long, kept_text string"
    return texts.join(last.hint("merge"), "dk", "left").mapInArrow(_cut(window), out)


def _numbered(rows: DataFrame) -> DataFrame:
    """dk, text, carried: ``dk`` names a document and orders documents by id.

    It is the id itself where every id has one text. Else, documents (id, text) are sorted and
    numbered, and a written table carries the numbers, so that no text is taken for its neighbour
    and rows without an id do not meet in one task.
    """
    marks = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")}
    named = rows.select("id", *(v.alias(k) for k, v in marks.items())).distinct()
    shared = named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    if not shared.limit(1).collect():
        return rows.select(F.coalesce("id", F.lit(NULL_ID)).alias("dk"), "text", "carried")
    order = materialize(named.orderBy(F.asc_nulls_first("id"), "h1", "h2").select("*", F.monotonically_increasing_id().alias("dk")), "numbers")
    n, r = order.hint("merge"), rows.withColumns(marks)
    on = r["id"].eqNullSafe(n["id"]) & (r["h1"] == n["h1"]) & (r["h2"] == n["h2"])
    return materialize(r.join(n, on).select("dk", "text", "carried"), "numbered")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Kept words of every document after the removal of windows of 20 words that start earlier elsewhere.

    A null or empty text has no words and the digest of the empty string; rows that repeat an id, or have none, are documents of their own;
    an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select("carried.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


__all__ = ["cut_repeats", "op10_substring_dedup"]
