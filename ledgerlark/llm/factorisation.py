"""Quality classifier: a factorisation machine.

Inputs are hashed words (a unit vector of counts), structure statistics of the text, and the
stored length as metadata. The score has a weight for each input and a weight for each pair,
the product of two short vectors; the sum over all pairs is half the square of a sum less the
sum of squares, so it is linear in the inputs. Training is on a bounded sample of labelled
rows; scoring runs over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, text_slices, word_bounds, word_hashes
from .text_stats import counts

BUCKETS = 1 << 16
FACTORS = 8
_CLASS = np.zeros((256, 6), bool)
_CLASS[65:91, 0] = True  # upper case
_CLASS[48:58, 1] = True  # digits
_CLASS[[33, 63], 2] = True  # exclamation and question marks
_CLASS[[44, 46, 58, 59], 3] = True  # other stops
_CLASS[128:, 4] = True  # beyond ASCII
_CLASS[10, 5] = True  # line ends
STATS = ["length", "word", "symbol", "line", "repeat", "upper", "digit", "mark", "stop", "wide", "break", "distinct", "metadata"]


def inputs(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, weight) of the hashed words, sorted by text, and the statistics of each text."""
    n = len(offsets) - 1
    start, end, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    bucket = (word_hashes(data, start, end) >> np.uint64(40)).astype(np.int64) % BUCKETS
    both, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, bucket = both // BUCKETS, both % BUCKETS
    norm = np.sqrt(np.bincount(doc, times.astype(float) ** 2, n))
    weight = times / np.maximum(norm, 1)[doc]
    words, chars, symbols, lines, repeats = (x.astype(float) for x in counts(data, offsets))
    each, size = np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    share = [np.diff(np.concatenate([[0], np.cumsum(_CLASS[data, k])])[offsets]) / size for k in range(6)]
    distinct = np.bincount(doc, minlength=n) / each
    stats = np.stack([np.log1p(words), chars / each, symbols / each, lines / each, repeats / each, *share, distinct, np.log1p(np.maximum(n_chars, 0))], 1)
    return doc, bucket, weight, stats


class Machine:
    """The parameters; all of bounded size."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = BUCKETS + len(STATS)
        self.bias, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def score(self, doc: np.ndarray, bucket: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, in time linear in the inputs."""
        n, x = len(stats), self.standard(stats)
        edge = np.searchsorted(doc, np.arange(n + 1))
        add = lambda a: np.diff(np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)])[edge], axis=0)
        v = self.v[bucket] * weight[:, None]
        vs = self.v[BUCKETS:]
        linear = self.bias + add(self.w[bucket] * weight) + x @ self.w[BUCKETS:]
        total = add(v) + x @ vs
        squares = add((v**2).sum(1)) + (x**2) @ (vs**2).sum(1)
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * ((total**2).sum(1) - squares), -30, 30)))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.02, decay: float = 1e-4, batch: int = 128) -> None:
        """Adam on batches; rows are (buckets, weights, statistics, label)."""
        stats, label = np.stack([r[2] for r in rows]), np.array([r[3] for r in rows], float)
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        x = self.standard(stats)
        # Both labels weigh the same.
        share = np.clip(label.mean(), 0.02, 0.98)
        importance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
        params = np.concatenate([self.w[:, None], self.v], 1)
        m, s = np.zeros_like(params), np.zeros_like(params)
        rng, step = np.random.default_rng(11), 0
        fixed = BUCKETS + np.arange(len(STATS))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                part, step = order[lo : lo + batch], step + 1
                used, at = np.unique(np.concatenate([rows[i][0] for i in part]), return_inverse=True)
                dense = np.zeros((len(part), len(used)))
                dense[np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part]), at] = np.concatenate([rows[i][1] for i in part])
                full, cols = np.concatenate([dense, x[part]], 1), np.concatenate([used, fixed])
                w, v = params[cols, 0], params[cols, 1:]
                total, square = full @ v, full**2
                z = self.bias + full @ w + 0.5 * ((total**2).sum(1) - square @ (v**2).sum(1))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) * importance[part] / len(part)
                grad = np.concatenate([(full.T @ g)[:, None], full.T @ (g[:, None] * total) - (square.T @ g)[:, None] * v], 1) + decay * params[cols] / len(part)
                m[cols] = 0.9 * m[cols] + 0.1 * grad
                s[cols] = 0.99 * s[cols] + 0.01 * grad**2
                params[cols] -= rate * (m[cols] / (1 - 0.9**step)) / (np.sqrt(s[cols] / (1 - 0.99**step)) + 1e-8)
                self.bias -= rate * g.sum()
        self.w, self.v = params[:, 0], params[:, 1:]


def _slices(batch: pa.RecordBatch):
    lengths = np.asarray(batch.column(batch.schema.get_field_index("n_chars")).fill_null(0))
    for lo, hi, data, offsets in text_slices(batch):
        yield lo, hi, *inputs(data, offsets, lengths[lo:hi].astype(float))


def _input_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        label, mark = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "mark"))
        for lo, hi, doc, bucket, weight, stats in _slices(batch):
            edge = np.searchsorted(doc, np.arange(hi - lo + 1))
            parts = [(bucket[a:b].astype(np.int32).tobytes(), weight[a:b].astype(np.float32).tobytes(), s.tobytes()) for a, b, s in zip(edge, edge[1:], stats, strict=False)]
            yield pa.record_batch([ids[lo:hi], label[lo:hi], mark[lo:hi], *(pa.array(list(c), pa.binary()) for c in zip(*parts, strict=True))], names=["doc_id", "label", "mark", "buckets", "weights", "stats"])


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            carried = batch.column(batch.schema.get_field_index("carried"))
            for lo, hi, *x in _slices(batch):
                yield pa.record_batch([carried[lo:hi], pa.array(machine.score(*x))], names=["carried", "score"])

    return run


def _text_and_length(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    stored = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [text.alias("text"), F.coalesce(stored, F.length(text).cast("long"), F.lit(0)).cast("long").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, sample_bytes: int = 128 << 20) -> Machine:
    """Train on at most ``sample`` rows of ``labels`` (doc_id, label), those of least hash of doc_id.

    Of these, in that order, only as many are used as have ``sample_bytes`` of inputs between them
    (8 bytes for each distinct word of a text, some 3 KB a text of ordinary length), so that both
    parameters bound what reaches the driver. A doc_id with several texts trains with the one of
    least hash, one with several labels with the greater. Without labelled rows of both kinds the
    machine scores the share of label 1, or a half.
    """
    small_batches(docs.sparkSession)
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), *_text_and_length(docs)).join(F.broadcast(chosen), "doc_id")
    made = texts.mapInArrow(_input_rows, "doc_id long, label int, mark long, buckets binary, weights binary, stats binary")
    columns = ["label", "buckets", "weights", "stats"]
    each = materialize(made.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct("mark", "stats")).alias("r")).select("doc_id", "r.*"), "inputs")
    # One number for each of ``sample`` rows at most.
    size = F.octet_length("buckets") + F.octet_length("weights") + F.octet_length("stats")
    upto = F.sum(size).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = each.select("doc_id", upto.alias("upto")).where(F.col("upto") <= sample_bytes).select("doc_id")
    found = each.join(F.broadcast(within), "doc_id").orderBy("doc_id").collect()
    rows = [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.weights, np.float32).astype(float), np.frombuffer(r.stats), r.label) for r in found]
    machine = Machine()
    if len({r[3] for r in rows}) == 2:
        machine.train(rows)
    elif rows:
        machine.bias = 2.0 if rows[0][3] else -2.0
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(carried, score) for every row; carried is a struct of all columns but text.

    A null or empty text is scored from its statistics alone; repeated rows score alike; an empty
    table gives an empty result. The model is broadcast: about five megabytes, by its parameters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rest = [c for c in docs.columns if c != "text"]
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), *_text_and_length(docs))
    return flat.mapInArrow(_score_rows(spark.sparkContext.broadcast(machine)), f"carried {flat.schema['carried'].dataType.simpleString()}, score double")


def held_out() -> Column:
    """Rows that never train: crc32 of the doc_id as text, modulo 5, is 0. A null doc_id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def op9_factorisation_machine(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled rows outside the held-out fold.

    A null or empty text is scored too; repeated rows are each scored alike; rows without an id have a score and are never learnt from; an empty
    table gives no rows; without labels every score is that of an untrained model.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    machine = fit(docs, labels.where(~held_out()))
    scored = score(docs, machine).select(F.col("carried.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


__all__ = ["Machine", "fit", "held_out", "op9_factorisation_machine", "score"]
