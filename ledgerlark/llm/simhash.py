"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits; the vector of their bit counts is kept
in unary code, so that the Manhattan distance of two vectors is one XOR and popcount. It is at
most the Hamming distance, since a bit that differs changes one count by at most one. Two
fingerprints within d bits thus lie within Manhattan distance d, and of k blocks of
coordinates at least k - d agree wholly: the grid has one cell for each choice of k - d blocks
and each value there, and every link shares a cell. Within a cell the Manhattan bound comes
first, then the exact distance. The number of blocks follows the number of distinct
fingerprints, so that the cells stay small as the input grows; any number finds all links.

Cells are read as sorted runs; see ``runs`` for crowded ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .components import components
from .runs import linked

_LOW_BITS = 0x5555555555555555
_HASH = partial(xxhash.xxh64_intdigest, seed=42)


def simhash(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text: the majority of each bit over the hashes of its word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _HASH(joined)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    begins = [0, *(e + 1 for e in ends)]
    hashes = np.fromiter((_HASH(joined[a:b]) for a, b in zip(begins, ends[shingle - 1 :], strict=False)), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo : lo + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            prints = np.fromiter((simhash(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            doc_id, mark = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "mark"))
            yield pa.record_batch([doc_id, mark, pa.array(prints.view(np.int64))], names=["doc_id", "mark", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, mark, fp: longs) of every row of ``docs``; A-Z are lowered, words are runs other than white space.

    A text with fewer words than a shingle is one shingle; a null or empty text has print zero.
    ``mark`` is a hash of the exact text, which tells rows with one doc_id apart.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("mark", F.xxhash64("text")).mapInArrow(_fingerprint_rows(shingle), "doc_id long, mark long, fp long")


def _block_masks(k: int) -> list[int]:
    """Bit masks of k blocks of whole two-bit segments."""
    edges = [round(32 * i / k) * 2 for i in range(k + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def grid_blocks(rows: int, distance: int) -> int:
    """The number of blocks with the least expected work: cells sent for a row, and rows met in them at a hundredth each."""
    cost = lambda k: comb(k, distance) + 0.01 * rows * comb(k, distance) * 0.375 ** (32 * (k - distance) / k)
    return min(range(distance + 2, distance + 9), key=cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(distance: int):
    """Whether pairs of rows are within the distance: the Manhattan bound first, then the exact count."""

    def near(rows: np.ndarray, i, j) -> np.ndarray:
        close = np.bitwise_count(rows[i, 1] ^ rows[j, 1]) <= distance
        return close & (np.bitwise_count(rows[i, 0] ^ rows[j, 0]) <= distance)

    return near


def _load(batch: pa.RecordBatch) -> np.ndarray:
    """Fingerprints and their embeddings."""
    fp = np.asarray(batch.column(batch.schema.get_field_index("id"))).view(np.uint64)
    return np.stack([fp, _unary(fp)], 1)


def _unary(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW_BITS)
    half = fp >> np.uint64(1)
    return ((fp | half) & low) | (((fp & half) & low) << np.uint64(1))


def near_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``prints`` (fp, distinct) at ``distance`` bits or fewer.

    All links of thin cells, and of crowded cells enough of them to connect what they connect.
    """
    k = grid_blocks(prints.count(), distance)
    masks = _block_masks(k)
    half = F.shiftrightunsigned("fp", 1)
    low = F.lit(_LOW_BITS)
    unary = (F.col("fp").bitwiseOR(half).bitwiseAND(low)).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(low), 1))
    keys = [F.xxhash64(F.lit(i), F.col("unary").bitwiseAND(F.lit(_signed(sum(kept))))) for i, kept in enumerate(combinations(masks, k - distance))]
    cells = prints.withColumn("unary", unary).select(F.explode(F.array(*keys)).alias("cell"), F.col("fp").alias("id"))
    return linked(cells, _load, _near(distance))


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of every row of ``docs``: the least doc_id that near fingerprints reach.

    ``root`` is the least fingerprint of the component, and names it even where ids are null.

    Needs doc_id and text; other columns are ignored. Null and empty texts share print zero and
    are linked like any other. A null doc_id gets a component like any row, but names one only
    if no other id is in it (then it is null). Repeated rows are returned as often as given. An
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, shingle), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(near_links(prints.select("fp"), distance))
    placed = prints.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy(F.col("root").alias("at")).agg(F.min("low").alias("component_id"))
    named = placed.join(least.hint("merge"), F.col("root") == F.col("at")).select(F.col("fp").alias("own"), "root", "component_id")
    return rows.join(materialize(named, "named").hint("merge"), F.col("fp") == F.col("own")).select("doc_id", "mark", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The row of least doc_id of each near-duplicate component, with all columns of ``docs``.

    A null doc_id stays only if its component has no other id; of repeated rows one stays.
    """
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    groups = near_groups(docs, shingle, distance)
    return rows_at(docs, groups.groupBy("root").agg(F.min(F.struct(last.alias("_id"), F.col("mark").alias("_mark"))).alias("s")).select("s.*").distinct())


def rows_at(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``stays`` (_id, _mark: an id and a hash of its text) names, one for each."""
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), last.alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_mark"))
    kept = keyed.join(stays.hint("merge"), ["_id", "_mark"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", "_mark").orderBy("_mark"))
    return kept.withColumn("_first", first).where("_first = 1").select("row.*")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Null, empty and blank texts have the fingerprint zero and link like any other; repeated rows are each returned with one component; a
    component whose rows all lack an id has a null name; other columns are ignored; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["fingerprints", "grid_blocks", "near_groups", "near_links", "one_of_each", "op6_simhash_near_dedup", "rows_at", "simhash"]
