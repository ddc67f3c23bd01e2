"""Scores of answers against a question bank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import numbers

#: Limits of a tidy answer.
LIMITS = {"numbers": 20, "documents": 4, "evidence_numbers": 60, "evidence_bytes": 4096, "chars": 1200}


def retrieval_checks(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results (query_id, docs), gold (query_id, gold_all, gold_any, k): each check, and the missing documents."""
    j = gold.join(results.hint("merge"), "query_id", "left").withColumn("docs", F.slice(F.coalesce("docs", F.array().cast("array<string>")), 1, 1000))
    missing = F.array_except("gold_all", "docs")
    return j.select("query_id", (F.size(missing) == 0).alias("has_all"), ((F.size("gold_any") == 0) | F.arrays_overlap("gold_any", "docs")).alias("has_any"), (F.size("docs") == F.col("k")).alias("count_ok"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def field_checks(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, field, value) against (id, field, expected, tol): equal within tol, nulls equal nulls."""
    j = expected.join(actual.hint("merge"), ["id", "field"], "left")
    ok = F.when(F.col("expected").isNull(), F.col("value").isNull()).otherwise(F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tol") + 1e-9, F.lit(False)))
    return j.select("id", "field", ok.alias("passed"))


def daily_checks(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Days of one side only, or with other values, by id: both have (id, date, net_revenue, orders)."""
    a = actual.select("id", "date", F.struct("net_revenue", "orders").alias("a"))
    e = expected.select("id", "date", F.struct("net_revenue", "orders").alias("e"))
    j = a.join(e.hint("merge"), ["id", "date"], "full_outer")
    return j.groupBy("id").agg(F.count_if(~F.col("a").eqNullSafe(F.col("e"))).alias("wrong_days"), F.count(F.lit(1)).alias("days"))


def _holds(values: Column, n: Column, tol: float = 0.011) -> Column:
    return F.exists(values, lambda v: F.abs(v - n) <= tol)


def number_checks(answers: DataFrame) -> DataFrame:
    """Answers (id, question, answer, want_all, want_any, want_none): numbers that must, may and must not occur, and none beyond the question's."""
    n, q = numbers("answer"), numbers("question")
    return answers.select(
        "id",
        F.forall("want_all", lambda x: _holds(n, x)).alias("all_ok"),
        ((F.size("want_any") == 0) | F.exists("want_any", lambda x: _holds(n, x))).alias("any_ok"),
        (~F.exists("want_none", lambda x: _holds(n, x))).alias("none_ok"),
        F.forall(n, lambda x: _holds(q, x)).alias("none_beyond_question"),
    )


def text_checks(answers: DataFrame) -> DataFrame:
    """Texts that must, may and must not occur, case and blanks aside."""
    form = lambda c: F.lower(F.regexp_replace(c, r"[\s*`|#>]+", ""))
    a = form("answer")
    has = lambda x: F.contains(a, form(x))
    return answers.select("id", F.forall("text_all", has).alias("all_ok"), ((F.size("text_any") == 0) | F.exists("text_any", has)).alias("any_ok"), (~F.exists("text_none", has)).alias("none_ok"))


def citation_checks(answers: DataFrame, longest: int = 400) -> DataFrame:
    """Answers (id, citations, cite_all, cite_any, cite_none, cite_max); long quotes do not count."""
    short = F.filter("citations", lambda c: F.length(c["quote"]) <= longest)
    docs = F.array_distinct(F.transform(short, lambda c: c["doc_id"]))
    return answers.select(
        "id",
        (F.size(F.array_except("cite_all", docs)) == 0).alias("all_ok"),
        ((F.size("cite_any") == 0) | F.arrays_overlap("cite_any", docs)).alias("any_ok"),
        (F.size(F.array_intersect("cite_none", docs)) == 0).alias("none_ok"),
        (F.size(docs) <= F.col("cite_max")).alias("max_ok"),
    )


def fact_checks(answers: DataFrame, longest: int = 400) -> DataFrame:
    """A fact in the answer, or in a short quote of an allowed document."""
    form = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    quotes = F.filter("citations", lambda c: (F.length(c["quote"]) <= longest) & F.array_contains(F.col("fact_docs"), c["doc_id"]))
    held = F.contains(form("answer"), form("fact")) | F.exists(quotes, lambda c: F.contains(form(c["quote"]), form("fact")))
    return answers.select("id", held.alias("passed"))


def delta_checks(answers: DataFrame) -> DataFrame:
    """The size of a change and one direction only (answer, delta)."""
    up, down = F.col("answer").rlike(r"(?i)涨|增|高|\bup\b|rose"), F.col("answer").rlike(r"(?i)跌|降|减|低|\bdown\b|fell")
    way = F.when(F.col("delta") > 0, up & ~down).when(F.col("delta") < 0, down & ~up).otherwise(~up & ~down)
    return answers.select("id", (_holds(F.transform(numbers("answer"), lambda x: F.abs(x)), F.abs("delta")) & way).alias("passed"))


def evidence_checks(answers: DataFrame) -> DataFrame:
    """Numbers that the results behind an answer must hold (results: JSON text, evidence_numbers)."""
    n = numbers("results")
    return answers.select("id", F.forall("evidence_numbers", lambda x: _holds(n, x)).alias("passed"))


def hygiene(answers: DataFrame) -> DataFrame:
    """Distinct numbers, cited documents, numbers and bytes of evidence and characters of each answer, and whether they keep the limits."""
    n, docs = F.size(F.array_distinct(numbers("answer"))), F.size(F.array_distinct(F.transform("citations", lambda c: c["doc_id"])))
    behind = F.size(F.array_distinct(numbers("results")))
    out = answers.select("id", n.alias("numbers"), docs.alias("documents"), behind.alias("evidence_numbers"), F.octet_length("results").alias("evidence_bytes"), F.length("answer").alias("chars"))
    return out.withColumn("tidy", reduce(lambda a, b: a & b, [F.col(k) <= v for k, v in LIMITS.items()]))


def question_scores(turns: DataFrame) -> DataFrame:
    """Points times the share of passed turns: (question_id, category, points, passed)."""
    got = turns.groupBy("question_id", "category", "points").agg(F.avg(F.col("passed").cast("int")).alias("share"), F.min("passed").alias("passed"))
    return got.select("question_id", "category", "points", F.round(F.col("points") * F.col("share"), 6).alias("earned"), "passed")


def category_scores(questions: DataFrame) -> DataFrame:
    """Points, earned, questions, passed and their ratio by category."""
    got = questions.groupBy("category").agg(F.sum("points").alias("points"), F.round(F.sum("earned"), 4).alias("earned"), F.count(F.lit(1)).alias("questions"), F.count_if("passed").alias("passed"))
    return got.withColumn("ratio", F.round(F.col("earned") / F.col("points"), 4))


def failed_checks(questions: DataFrame, checks: DataFrame, n: int = 20) -> DataFrame:
    """Category, failed: the names of checks (question_id, name, passed) that some question of the category failed, sorted; the first ``n``.

    Names are made distinct before they are ranked, so a list is bounded by ``n``.
    """
    names = checks.where("NOT passed").join(questions.select("question_id", "category").hint("merge"), "question_id").select("category", "name").distinct()
    first = names.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("name"))).where(F.col("r") <= n)
    lists = first.groupBy("category").agg(F.sort_array(F.collect_list("name")).alias("failed"))
    every = questions.select("category").distinct()
    return every.join(lists.hint("merge"), "category", "left").select("category", F.coalesce("failed", F.array().cast("array<string>")).alias("failed"))


def latency(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Exact median, maximum and total."""
    return rows.groupBy(*by).agg(F.median(column).alias("median"), F.max(column).alias("max"), F.round(F.sum(column), 4).alias("total"))


def regression(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Earned points by category now and before; categories of one side count as 0 on the other."""
    b = baseline.select("category", F.col("earned").alias("before"))
    j = current.select("category", F.col("earned").alias("now")).join(b.hint("merge"), "category", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("category", zero("before").alias("before"), zero("now").alias("now"), (zero("now") < zero("before")).alias("regressed"))
