"""Quality rules by robust multivariate outliers.

Five transformed statistics of a text (length, mean word length, symbols, repeated lines,
repeated words) are compared with a minimum-covariance-determinant estimate of their language
and source: the mean and covariance of the three quarters of texts that lie closest together.
A text is rejected where its Mahalanobis distance is improbable under that estimate.

Each group has four starts: medians and quartiles, all its rows, and its shorter and longer
half. Every start is concentrated in steps until its determinant falls no more, rounding aside, and the
start of least determinant gives the estimate. One step is one aggregation for all groups and
starts: sums by distance bucket, of which the nearest are added up to the coverage, the last
one in part. Groups with few rows fall back to their language, then to all rows. All rows
count; nothing is sampled, and no group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .text_stats import NAMES, text_stats

FEATURES = ["f_length", "f_word", "f_symbol", "f_line", "f_repeat"]
#: The least standard deviation of each feature: most texts have no symbol and no repeat at all.
FLOORS = np.array([0.5, 0.06, 0.15, 0.1, 0.15])
_D = len(FEATURES)
#: Up to so many groups (some 300 bytes each) an estimate is broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
_SALTS = 64
#: A start has settled when a step lowers the logarithm of its determinant by no more than rounding may.
SETTLED = 1e-9


def gamma_cdf(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * exp(-x + a * log(x) - lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    """The value that a chi-square variable with d degrees stays under with probability p."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_cdf(d / 2, mid / 2) < p else (lo, mid)
    return hi


def base_failed() -> Column:
    """The base rule: fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log1p(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(10 * F.col("n_dup_lines") / n), F.col("n_repeat_words") / n]
    return stats.select("*", *(v.alias(c) for v, c in zip(values, FEATURES, strict=True)), base_failed().alias("base_failed"))


def _distance() -> Column:
    off = [F.col(c) - F.col("mean")[i] for i, c in enumerate(FEATURES)]
    terms = [(1 if i == j else 2) * F.col("inverse")[i * _D + j] * off[i] * off[j] for i in range(_D) for j in range(i, _D)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _with_estimate(rows: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    """Each row with its group's estimate; a hot group is dealt over salts where the estimate is not broadcast."""
    side = estimate.withColumnRenamed("grp", "_grp")
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(side), F.col("grp") == F.col("_grp"), "left").drop("_grp")
    side = side.withColumn("_salt2", F.explode(F.array(*(F.lit(i) for i in range(_SALTS)))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*FEATURES), F.lit(_SALTS)).cast("int"))
    return salted.join(side.hint("merge"), (F.col("grp") == F.col("_grp")) & (F.col("_salt") == F.col("_salt2")), "left").drop("_grp", "_salt", "_salt2")


_ESTIMATE = "grp string, start int, mean array<double>, inverse array<double>, logdet double"
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_SUMS = [*(f"s{i}" for i in range(_D)), *(f"s{i}{j}" for i, j in _PAIRS)]
STARTS = ["quartiles", "all", "shorter", "longer"]


def regular(cov: np.ndarray) -> np.ndarray:
    """A covariance whose features vary by their floor at least; one that was lifted is independent of the others."""
    own = cov.diagonal()
    free = (own >= FLOORS**2).astype(float)
    out = cov * free[:, None] * free[None, :]
    out[np.diag_indices(_D)] = np.maximum(own, FLOORS**2)
    return out + np.eye(_D) * 1e-9


def _from_quartiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        q = [np.stack([np.asarray(x, float) for x in pdf[c]]) if len(pdf) else np.zeros((0, 3)) for c in FEATURES]
        mean = np.stack([x[:, 1] for x in q], 1)
        scale = np.maximum(np.stack([(x[:, 2] - x[:, 0]) / 1.349 for x in q], 1), FLOORS)
        inverse = [np.diag(1 / s**2).ravel().tolist() for s in scale]
        yield pd.DataFrame({"grp": pdf["grp"], "start": 0, "mean": mean.tolist(), "inverse": inverse, "logdet": 2 * np.log(scale).sum(1)})


def _from_sums(factor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            means, inverses, logdets = [], [], []
            for row in pdf.to_dict("records"):
                n = row["n"]
                mean = np.array([row[f"s{i}"] for i in range(_D)]) / n
                cov = np.zeros((_D, _D))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = row[f"s{i}{j}"] / n - mean[i] * mean[j]
                cov = regular(cov * factor)
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                logdets.append(float(np.linalg.slogdet(cov)[1]))
            made = pd.DataFrame({"grp": pdf["grp"], "start": pdf["start"].astype("int32"), "mean": means, "inverse": inverses, "logdet": logdets})
            yield made.assign(was=pdf["was"]) if "was" in pdf else made

    return run


def group_of(rows: DataFrame, lang: str, source: str) -> tuple[Column, Column]:
    """Names of the language-source and language groups; a null is a value of its own."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.concat_ws("\t", value(lang), value(source)), value(lang)


def consistency(coverage: float) -> float:
    """What a covariance of the nearest ``coverage`` is multiplied by, so that it estimates that of normal data."""
    return coverage / gamma_cdf(_D / 2 + 1, chi2_quantile(coverage, _D) / 2)


def fit_estimates(rows: DataFrame, least: int = 200, coverage: float = 0.75, steps: int = 500) -> tuple[DataFrame, DataFrame, int]:
    """(names, estimates, groups) over rows with lang_source, lang_only, base_failed and FEATURES.

    ``names`` maps lang_source to the group that judges it; groups of fewer than ``least`` rows
    that pass the base use their language's, or that of all rows. ``estimates`` has the number of steps of the
    start that was kept. A step lowers the determinant or ends its start, so starts settle by themselves; one that has not done so after
    ``steps`` is an error.
    """
    good = rows.where(~F.col("base_failed"))
    sizes = good.groupBy("lang_source", "lang_only").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang_only"))
    chosen = F.when(F.col("n") >= least, F.col("lang_source")).when(F.col("n1") >= least, F.col("lang_only")).otherwise(F.lit("all"))
    names = materialize(sizes.withColumn("n1", total).select("lang_source", "lang_only", chosen.alias("own")), "groups")
    groups = names.count()
    # A row counts at each level that judges some group: its own, its language, all.
    used = names.select(F.col("own").alias("grp")).distinct()
    used = F.broadcast(used) if groups <= BROADCAST_GROUPS else used.hint("merge")
    levels = F.array(F.col("lang_source"), F.col("lang_only"), F.lit("all"))
    wide = materialize(good.select(F.explode(levels).alias("grp"), *FEATURES).join(used, "grp", "left_semi"), "wide")
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}{j}") for i, j in _PAIRS]
    factor = consistency(coverage)

    quartiles = wide.groupBy("grp").agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(c) for c in FEATURES))
    first = materialize(quartiles.mapInPandas(_from_quartiles, _ESTIMATE), "estimate")
    half = F.when(F.col(FEATURES[0]) <= F.col("mean")[0], 2).otherwise(3)
    halves = _with_estimate(wide, first, groups).select("grp", F.explode(F.array(F.lit(1), half)).alias("start"), *FEATURES)
    others = halves.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"), *sums).mapInPandas(_from_sums(1.0), _ESTIMATE)
    now = materialize(first.unionByName(others), "estimate")

    # Starts that still fall, and those that have settled.
    settled: list[DataFrame] = []
    for step in range(1, steps + 1):
        near = _with_estimate(wide, now, len(STARTS) * groups).where("start is not null")
        near = near.withColumn("bucket", F.least(F.lit(1000), F.floor(F.log1p(F.greatest(_distance(), F.lit(0.0))) * 100)))
        buckets = near.groupBy("grp", "start", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("logdet").alias("was"), *sums)
        own = Window.partitionBy("grp", "start")
        before = F.coalesce(F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        share = (coverage * F.sum("n").over(own) - before) / F.col("n")
        inner = buckets.withColumn("share", F.least(F.lit(1.0), share)).where("share > 0")
        added = inner.groupBy("grp", "start").agg(F.max("was").alias("was"), *(F.sum(F.col(c) * F.col("share")).alias(c) for c in ["n", *_SUMS]))
        moved = added.mapInPandas(_from_sums(factor), f"{_ESTIMATE}, was double")
        # The first step changes from a plain to a consistent covariance, so it never settles a start.
        moved = materialize(moved.withColumn("falls", (F.col("logdet") < F.col("was") - SETTLED) | F.lit(not settled)), "estimate")
        settled.append(moved.where("NOT falls").drop("was", "falls").withColumn("steps", F.lit(step)))
        now = moved.where("falls").drop("was", "falls")
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"a start has not settled after {steps} steps")
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    best = every.groupBy("grp").agg(F.min_by(F.struct("mean", "inverse", "logdet", "steps"), F.struct("logdet", "start")).alias("b"))
    return names, materialize(best.select("grp", "b.*"), "estimate"), groups


def judge(docs: DataFrame, keep_text: bool = True, least: int = 200, coverage: float = 0.75, tail: float = 1e-6) -> DataFrame:
    """Every row of ``docs`` with its statistics, distance and verdict.

    Needs text, lang and source; returns row (a struct of the input's columns, without text unless
    ``keep_text``), the columns of NAMES, base_failed, distance (squared Mahalanobis, null where no
    estimate exists) and kept: not base_failed, and the distance within the chi-square quantile of
    1 - ``tail``. A null text has no words and so fails; null lang and source are groups of their
    own; repeated rows are judged alike; an empty table gives an empty result.
    """
    names_in = docs.columns

    def stats_of(names: list[str]) -> DataFrame:
        both = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.struct("lang", "source").alias("of"))
        stats = with_features(text_stats(both))
        first, second = group_of(stats, "carried.of.lang", "carried.of.source")
        return stats.select(F.col("carried.row").alias("row"), *NAMES, *FEATURES, "base_failed", first.alias("lang_source"), second.alias("lang_only"))

    rows = materialize(stats_of([c for c in names_in if c != "text"]), "stats")
    names, estimate, groups = fit_estimates(rows, least, coverage)
    own = names.select(F.col("lang_source").alias("_name"), "own").join(estimate.hint("merge"), F.col("own") == F.col("grp")).select(F.col("_name").alias("grp"), "mean", "inverse")
    # Texts that are to be returned are scanned once more: writing them beside their statistics would take their size on disk.
    rows = stats_of(names_in) if keep_text else rows
    near = _with_estimate(rows.withColumn("grp", F.col("lang_source")), materialize(own, "judges"), groups)
    far = _distance()
    kept = ~F.col("base_failed") & F.coalesce(far <= chi2_quantile(1 - tail, _D), F.lit(True))
    return near.select("row", *NAMES, "base_failed", far.alias("distance"), kept.alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document.

    A null or empty text has zeros and fails the base; null languages and sources are groups of their own; repeated rows, and rows
    without an id, are each judged; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    judged = judge(docs, keep_text=False)
    return judged.select("row.doc_id", *NAMES, "base_failed", "kept", "distance")


__all__ = ["chi2_quantile", "fit_estimates", "judge", "op3_quality_rules"]
