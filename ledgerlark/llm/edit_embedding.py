"""Document fingerprints by a randomised edit embedding.

A walk reads a text character by character: at each step a coin shared by all documents, thrown
for the step and the character, says whether to move on or to stay. Texts a few edits apart
fall into step again after each edit, so the walks meet the same characters at most steps: edit
distance becomes Hamming distance. A fingerprint samples one step for each of 256 places; the
step of a place is the least by a shared random order among the steps the walk has, so texts of
nearly the same length sample the same steps, and the sample covers the whole text. What is
kept of a step is a byte of a hash of the eight characters that begin where the walk stands.

Near pairs are found by bands of sampled places and verified on the whole fingerprint. A band
takes the first places of its own order at which a walk has a step, so short texts, which have
few, do not meet in cells of empty places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, list_array, materialize, mix, small_batches
from .components import components
from .runs import linked

PLACES = 256
GRAM = 8
#: Characters whose walks go in step; a longer text goes with fewer others, always whole.
_LOCKSTEP = 8_000_000
_PERIOD = 4096
_COINS = np.random.default_rng(97).integers(0, 2, (_PERIOD, 256), dtype=np.uint8)
_STEPS: list[list[np.ndarray]] = []


def _samples(longest: int) -> list[np.ndarray]:
    """For each place, the steps that are the least of its order so far, up to ``longest``."""
    have = 0 if not _STEPS else int(_STEPS[0][0][0])
    if not _STEPS or have < longest:
        size = max(1 << 18, 1 << max(0, longest - 1).bit_length())
        step = np.arange(size, dtype=np.uint64)
        order = mix((step + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        place = (mix(order ^ np.uint64(0x1234567)) % np.uint64(PLACES)).astype(np.int64)
        found = []
        for k in range(PLACES):
            own = np.flatnonzero(place == k)
            least = np.minimum.accumulate(order[own])
            found.append(own[order[own] == least])
        _STEPS[:] = [[np.array([size])], found]
    return _STEPS[1]


def _walks(texts: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (a row of bytes each) of texts given as code points."""
    size = np.array([len(t) for t in texts], np.int64)
    rank = np.argsort(-size, kind="stable")
    size = size[rank]
    begin = np.cumsum(size + GRAM) - (size + GRAM)
    pad = np.zeros(GRAM, np.uint32)
    points = np.concatenate([x for i in rank for x in (texts[i], pad)]) if len(texts) else pad
    letter = (points * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    steps = 2 * size
    records = _samples(int(steps[0]) if len(steps) else 1)
    chosen = np.stack([np.searchsorted(r, steps) for r in records], 1) - 1
    wanted = np.stack([np.where(chosen[:, k] >= 0, r[np.maximum(chosen[:, k], 0)], -1) for k, r in enumerate(records)], 1)
    # Visits in the order of steps: which text and place each serves.
    text_of, place_of = np.nonzero(wanted >= 0)
    when = wanted[text_of, place_of]
    order = np.argsort(when, kind="stable")
    text_of, place_of, when = text_of[order], place_of[order], when[order]
    if not len(when):
        return np.zeros((len(texts), PLACES), np.uint8)
    edges = np.flatnonzero(np.append(True, when[1:] != when[:-1]))
    stops = dict(zip(when[edges].tolist(), zip(edges.tolist(), np.append(edges[1:], len(when)).tolist(), strict=True), strict=True))
    at, end = begin.copy(), begin + size
    seen = np.zeros(len(when), np.int64)
    # Texts in descending length: those still walking are always a prefix.
    total = int(steps[0]) if len(steps) else 0
    live = len(steps)
    ends = steps.tolist()
    for step in range(total):
        while live and ends[live - 1] <= step:
            live -= 1
        here = at[:live]
        visit = stops.get(step)
        if visit:
            lo, hi = visit
            seen[lo:hi] = at[text_of[lo:hi]]
        here += _COINS[step % _PERIOD].take(letter.take(here))
        np.minimum(here, end[:live], out=here)
    symbol = np.zeros(len(seen), np.uint64)
    for k in range(GRAM):
        reach = seen + k
        inside = reach < end[text_of]
        symbol = symbol * np.uint64(0x100000001B3) + np.where(inside, points[np.minimum(reach, len(points) - 1)], 0).astype(np.uint64)
    prints = np.zeros((len(texts), PLACES), np.uint8)
    # Zero says that a walk has no step for a place.
    prints[text_of, place_of] = (mix(symbol) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    out = np.zeros_like(prints)
    out[rank] = prints
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts; texts of like length walk together, some millions of characters at once."""
    out = np.zeros((len(texts), PLACES), np.uint8)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lo = 0
    while lo < len(order):
        hi, room = lo, _LOCKSTEP
        while hi < len(order) and (hi == lo or room >= len(texts[order[hi]])):
            room -= len(texts[order[hi]])
            hi += 1
        part = order[lo:hi]
        out[part] = _walks([code_points(texts[i]) for i in part])
        lo = hi
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of places at which two fingerprints agree, of those that either has; two empty texts are alike."""
    either = (a > 0) | (b > 0)
    return np.where(either.any(-1), ((a == b) & either).sum(-1) / np.maximum(either.sum(-1), 1), 1.0)


def _hex(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints]


# ---- fingerprints and near pairs -------------------------------------------


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        yield pa.record_batch([batch.column(batch.schema.get_field_index("carried")), pa.array([r.tobytes() for r in fingerprint_texts(texts)], pa.binary())], names=["carried", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(carried, fingerprint binary) of every row; carried is a struct of all columns but text.

    Equal texts have equal fingerprints; a null text is an empty one, whose print is all zero. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession, 4000)
    rest = [c for c in docs.columns if c != "text"]
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), F.col("text").cast("string").alias("text"))
    return flat.mapInArrow(_print_rows, f"carried {flat.schema['carried'].dataType.simpleString()}, fingerprint binary")


def _near(least: float):
    def near(rows: np.ndarray, i, j) -> np.ndarray:
        return likeness(rows[i], rows[j]) >= least

    return near


def _load(batch: pa.RecordBatch) -> np.ndarray:
    prints = batch.column(batch.schema.get_field_index("fingerprint"))
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, PLACES)


_LETTERS = np.random.default_rng(23).integers(1, 2**63, (PLACES, 256), dtype=np.uint64)


def band_cells(prints: np.ndarray, bands: int, width: int) -> np.ndarray:
    """The cell of each fingerprint in each band: its first ``width`` places, in the band's order, that hold a step."""
    orders = np.random.default_rng(5)
    out = np.zeros((len(prints), bands), np.uint64)
    for band in range(bands):
        order = orders.permutation(PLACES)
        seen = prints[:, order]
        taken = seen > 0
        taken &= np.cumsum(taken, 1, dtype=np.int16) <= width
        out[:, band] = mix(np.where(taken, _LETTERS[order, seen], 0).sum(1, dtype=np.uint64) + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return out


_PLACE_KEYS = np.random.default_rng(29).integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def print_ids(prints: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint."""
    return mix((mix(_PLACE_KEYS * (prints.astype(np.uint64) + np.uint64(1)))).sum(1, dtype=np.uint64))


def _id_rows(bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dk, mark = (batch.column(batch.schema.get_field_index(c)) for c in ("dk", "mark"))
            prints = fingerprint_texts([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
            cells = list_array(band_cells(prints, bands, width).view(np.int64).ravel(), np.full(len(prints), bands), pa.int64())
            yield pa.record_batch([dk, mark, pa.array(print_ids(prints).view(np.int64)), cells, pa.array([r.tobytes() for r in prints], pa.binary())], names=["dk", "mark", "id", "cells", "fingerprint"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """dk, doc_id, mark, text: ids that are never null, and a hash that tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(id_key().alias("dk"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _classes(docs: DataFrame, least: float, bands: int, width: int) -> DataFrame:
    """(dk, mark, class_id) for each distinct dk and mark of ``_keyed``."""
    small_batches(docs.sparkSession)
    texts = _keyed(docs)
    rows = materialize(texts.select("dk", "mark", "text").mapInArrow(_id_rows(bands, width), "dk long, mark long, id long, cells array<long>, fingerprint binary"), "ids")
    nodes = materialize(rows.groupBy("id").agg(F.min("dk").alias("low"), F.first("cells").alias("cells")), "nodes")
    cell = Window.partitionBy("cell")
    met = nodes.select(F.explode("cells").alias("cell"), "id").withColumn("n", F.count(F.lit(1)).over(cell)).where("n > 1").withColumn("all", F.bit_xor(F.xxhash64("id")).over(cell))
    # Cells with the same members say the same: one of them is verified.
    met = materialize(met, "met")
    once = met.groupBy("n", "all").agg(F.min("cell").alias("cell")).select("cell")
    kept = materialize(met.join(once.hint("merge"), "cell", "left_semi").select("cell", "id"), "shared")
    wanted = kept.select("id").distinct()
    prints = rows.select("id", "fingerprint").join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    cells = kept.join(materialize(prints, "prints").hint("merge"), "id").select("cell", "id", "fingerprint")
    roots = components(linked(cells, _load, _near(least)))
    placed = nodes.select("id", "low").join(roots.hint("merge"), F.col("id") == F.col("node"), "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    known = F.when(F.col("low") > NULL_ID, F.col("low"))
    first = placed.groupBy(F.col("root").alias("at")).agg(F.min(known).alias("class_id"))
    named = materialize(placed.join(first.hint("merge"), F.col("root") == F.col("at")).select(F.col("id").alias("own"), "class_id"), "named")
    return rows.select("dk", "mark", "id").join(named.hint("merge"), F.col("id") == F.col("own")).select("dk", "mark", "class_id").distinct()


def near_classes(docs: DataFrame, least: float = 0.8, bands: int = 8, width: int = 4) -> DataFrame:
    """(doc_id, class_id) of every row: the least doc_id that texts of likeness ``least`` or more reach.

    Equal fingerprints are one node. A node enters ``bands`` cells, each named by ``width``
    sampled places; nodes that share a cell are verified on all places. A pair of likeness s
    shares no band with a chance of (1 - s**4)**8: 0.015 at 0.8, 0.0002 at 0.9. A class whose
    rows all lack an id has none. Null and empty texts are one class; rows that repeat are each
    returned; other columns are ignored; an empty table gives an empty result.
    """
    rows = _keyed(docs).select("dk", "doc_id", "mark")
    found = _classes(docs, least, bands, width).select(F.col("dk").alias("_dk"), F.col("mark").alias("_mark"), "class_id")
    return rows.join(found.hint("merge"), (F.col("dk") == F.col("_dk")) & (F.col("mark") == F.col("_mark"))).select("doc_id", "class_id")


# ---- neighbours in the order of ids ----------------------------------------


def with_next(docs: DataFrame, run, schema: str, beside: DataFrame | None = None, range_bytes: int = 16 << 20, most: int = 20_000) -> DataFrame:
    """Apply ``run`` (a mapInArrow function) to rows sorted by descending doc_id, each range followed by its next row.

    Columns: part, ahead, dk, doc_id, mark, text, value. Rows of a part are consecutive; the last
    row of a part has ahead = 1, and is the first of the next part (the first of all after the last
    part). Texts are shuffled once. ``beside`` (dk, mark, value) comes as rows without a text, each
    before the rows it belongs to. A null text is empty; rows without an id come last; rows of one
    id are in the order of a hash of their texts, and where they are many they fill several parts;
    an empty table gives an empty result. The driver holds one key for each of some ``most`` parts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _keyed(docs)
    keys = materialize(rows.select("dk", "mark", F.octet_length("text").cast("long").alias("size")), "keys")
    count, size = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    tasks = max(1, min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // range_bytes))))
    # Several parts a task, so that the tasks stay even although parts are dealt by hash.
    parts = int(max(1, min(most, count, 8 * tasks)))
    cuts = [i / parts for i in range(1, parts)]
    accuracy = max(10_000, 20 * parts)
    splits = np.array((keys.agg(F.percentile_approx("dk", cuts, accuracy)).first()[0] if parts > 1 else []) or [], np.int64)
    edges, times = np.unique(splits, return_counts=True)
    # An id that fills whole parts (or many rows without one) is cut by the hashes of its texts.
    inner: dict[int, np.ndarray] = {}
    many = edges[times > 2].tolist()
    if many:
        hot = keys.where(F.col("dk").isin(many)).groupBy("dk").agg(F.percentile_approx("mark", cuts, accuracy).alias("m"))
        inner = {r.dk: np.unique(np.array(r.m, np.int64)[:: max(1, len(cuts) // int(times[edges == r.dk][0]))]) for r in hot.collect()}
    ahead_of = {dk: sum(len(m) for d, m in inner.items() if d > dk) for dk in inner}
    extra = np.array([sum(len(m) for d, m in inner.items() if d > e) for e in edges] + [0], np.int64)

    @F.pandas_udf("int")
    def part_of(dk: pd.Series, mark: pd.Series) -> pd.Series:
        d, m = dk.to_numpy(), mark.to_numpy()
        place = np.searchsorted(edges, d, "left")
        part = len(edges) - place + extra[place]
        for key, marks in inner.items():
            own = d == key
            part[own] = len(edges) - place[own] + ahead_of[key] + len(marks) - np.searchsorted(marks, m[own], "left")
        return pd.Series(part).astype("int32")

    heads = keys.groupBy(part_of("dk", "mark").alias("part")).agg(F.max(F.struct("dk", "mark")).alias("head")).orderBy("part").collect()
    # One row a part, so bounded by ``most``: the first row of a part also closes the part before it.
    targets = [(heads[i].head.dk, heads[i].head.mark, heads[i - 1].part) for i in range(len(heads))]
    ahead = spark.createDataFrame(targets, "_dk long, _mark long, before int")
    joined = rows.withColumn("part", part_of("dk", "mark")).join(F.broadcast(ahead), (F.col("dk") == F.col("_dk")) & (F.col("mark") == F.col("_mark")), "left")
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead"))
    copies = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("before").alias("part"), F.lit(1).alias("ahead"))))
    spread = joined.withColumn("to", F.explode(copies)).select("to.part", "to.ahead", "dk", "doc_id", "mark", "text", F.lit(None).cast("long").alias("value"))
    if beside is not None:
        none = lambda kind: F.lit(None).cast(kind)
        spread = spread.unionByName(beside.select(part_of("dk", "mark").alias("part"), F.lit(0).alias("ahead"), "dk", none("long").alias("doc_id"), "mark", none("string").alias("text"), "value"))
    order = ["part", "ahead", F.desc("dk"), F.desc("mark"), F.col("text").isNotNull()]
    return spread.repartition(tasks, "part").sortWithinPartitions(*order).mapInArrow(run, schema)


def _edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, int | None, str, int | None]] = []
    size = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        own = [i for i in range(len(held)) if not held[i][1] and i + 1 < len(held)]
        if own:
            texts = [h[3] for h in held]
            edited = []
            for i in own:
                cut = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            prints = fingerprint_texts(texts + edited)
            mine, after, new = prints[own], prints[[i + 1 for i in own]], prints[len(texts) :]
            yield pa.record_batch(
                [
                    pa.array([held[i][2] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(_hex(mine), pa.string()),
                    pa.array(_hex(new), pa.string()),
                    pa.array(likeness(mine, new)),
                    pa.array(likeness(mine, after)),
                    pa.array([held[i][4] for i in own], pa.int64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"],
            )
        held = held[-1:] if held and not held[-1][1] and not last else []
        size = sum(len(h[3]) for h in held)

    skip = None
    value = None
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "ahead", "doc_id", "text", "value"))
        for part, ahead, doc_id, text, own in zip(*columns, strict=True):
            if text is None:
                value = own  # of the rows that follow
                continue
            if ahead and skip == part:
                continue  # rows that repeat the head of the next part follow it here too
            skip = part if ahead else None
            held.append((part, ahead, doc_id, text, value))
            size += len(text)
            if size >= _LOCKSTEP and not ahead:
                yield from flush(False)
    yield from flush(True)


def op5_edit_embedding(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and the class of near documents (least doc_id).

    A null or empty text has a print of zeros, is alike to other empty texts only, and is edited into nothing. Repeated rows are
    each returned, and one may be the next of another; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    classes = materialize(_classes(docs, 0.8, 8, 4).withColumnRenamed("class_id", "value"), "classes")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"
    return with_next(docs, _edited_rows, schema, classes)


__all__ = ["band_cells", "fingerprint_texts", "fingerprints", "likeness", "near_classes", "op5_edit_embedding", "with_next"]
