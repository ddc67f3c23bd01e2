"""Registered queries over sales (S, P, F, J, A, W, K, U rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import cleaning as C
from ..operators import metrics as M
from ..sources import sales as S
from ..sources.scratch import built_once
from .registry import query

START, END = "1995-01-01", "1996-12-31"

_DATE = r"""CASE WHEN regexp_full_match(trim({c}), '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}') THEN CAST(try_strptime(replace(trim({c}), '/', '-'), '%Y-%m-%d') AS DATE)
  WHEN regexp_full_match(trim({c}), '\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}') THEN CAST(try_strptime(replace(trim({c}), '/', '-'), '%d-%m-%Y') AS DATE) END"""
_NUMBER = "TRY_CAST(replace(replace(replace({c}, '¥', ''), '￥', ''), ' ', '') AS DECIMAL(30, 6))"
_QTY = "TRY_CAST({c} AS DECIMAL(30, 6))"

BASE_SQL = f"""WITH raw_sales AS ({S.RAW_SALES_SQL}), stores AS ({S.STORES_SQL}), products AS ({S.PRODUCTS_SQL}),
parsed AS (SELECT upper(trim(order_id)) AS order_id, {_DATE.format(c="date")} AS date, upper(trim(store_id)) AS store_id, upper(trim(product_id)) AS product_id,
  CASE WHEN {_QTY.format(c="qty")} = floor({_QTY.format(c="qty")}) THEN CAST({_QTY.format(c="qty")} AS BIGINT) END AS qty,
  CAST({_NUMBER.format(c="amount")} * 100 AS BIGINT) AS amount_cents, upper(trim(payment)) AS payment, date AS raw_date, qty AS raw_qty, amount AS raw_amount,
  CASE WHEN amount = '' THEN 'empty' WHEN {_NUMBER.format(c="amount")} IS NULL THEN 'bad' ELSE 'ok' END AS amount_status FROM raw_sales),
flagged AS (SELECT p.*, CASE WHEN amount_cents < 0 THEN 1 ELSE 0 END AS is_refund, pr.unit_price,
  CASE WHEN date IS NULL THEN '1_unparseable_date' WHEN amount_cents IS NULL THEN '2_empty_amount' WHEN qty IS NULL OR qty <= 0 THEN '3_qty_le_zero'
       WHEN s.store_id IS NULL THEN '4_store_not_in_stores' WHEN pr.product_id IS NULL THEN '5_product_not_in_products' END AS r
  FROM parsed p LEFT JOIN stores s ON p.store_id = s.store_id LEFT JOIN products pr ON p.product_id = pr.product_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY order_id, date, store_id, product_id, qty, amount_cents, payment, r IS NULL ORDER BY raw_date, raw_qty, raw_amount) AS copy FROM flagged),
v3 AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN copy > 1 THEN '6_duplicate_row' WHEN amount_cents = 0 THEN '7_zero_amount' END AS reject_v3 FROM numbered),
filled AS (SELECT *, CASE WHEN reject_v3 = '2_empty_amount' AND qty > 0 AND unit_price IS NOT NULL THEN CAST(unit_price * 100 AS BIGINT) * qty END AS backfilled_cents FROM v3),
lines AS (SELECT *, coalesce(CASE WHEN backfilled_cents IS NOT NULL THEN NULL ELSE reject_v3 END, CASE WHEN is_refund = 1 THEN 'v2_refund_excluded' END) AS reject_v2 FROM filled),
clean AS (SELECT * FROM lines WHERE reject_v3 IS NULL)
"""
WINDOW_SQL = f"date BETWEEN DATE '{START}' AND DATE '{END}'"


def sums_sql(by: str, source: str = "clean", cents: str = "amount_cents") -> str:
    """Sums in cents by columns."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {keys}CAST(coalesce(sum({cents}), 0) AS BIGINT) AS net_cents, CAST(coalesce(sum(CASE WHEN is_refund = 1 THEN -{cents} END), 0) AS BIGINT) AS refund_cents, "
        f"count(DISTINCT CASE WHEN is_refund = 0 THEN order_id END) AS orders, CAST(coalesce(sum(CASE WHEN is_refund = 1 THEN -qty ELSE qty END), 0) AS BIGINT) AS qty FROM {source}{group}"
    )


AOV_SQL = "CASE WHEN orders > 0 THEN sign(net_cents) * ((2 * abs(net_cents) + orders) // (2 * orders)) / 100.0 END"
SHAPE_SQL = f"net_cents / 100.0 AS net_revenue, refund_cents / 100.0 AS refund_amount, orders, {AOV_SQL} AS aov, qty"


def parsed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed lines, written at their first use: every field is parsed once a session."""
    return built_once(spark, ("parsed", sf_dir), S.state(spark, sf_dir), lambda: C.parse_lines(S.raw_sales(spark, sf_dir)), "zstd")


def unknown_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of lines that no dimension has, written at their first use."""
    return built_once(spark, ("unknown", sf_dir), S.state(spark, sf_dir), lambda: C.unknown_ids(parsed_of(spark, sf_dir), S.stores(spark, sf_dir), S.products(spark, sf_dir)))


def flagged_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and flagged lines."""
    return C.flag(parsed_of(spark, sf_dir), unknown_of(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table (S10) from the flagged lines, not written."""
    return C.clean_flagged(flagged_of(spark, sf_dir), S.products(spark, sf_dir))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table (S10), written at its first use; the metrics read it."""
    return built_once(spark, ("lines", sf_dir), S.state(spark, sf_dir), lambda: cleaned(spark, sf_dir), "zstd")


@query("S01_raw_sales", f"SELECT * FROM ({S.RAW_SALES_SQL})")
def s01(spark, d):
    return S.raw_sales(spark, d)


@query("S02_dimensions", f"SELECT 'store' AS kind, store_id AS id, store_name AS name, category AS detail FROM ({S.STORES_SQL}) UNION ALL SELECT 'product', product_id, product_name, product_category FROM ({S.PRODUCTS_SQL})")
def s02(spark, d):
    s = S.stores(spark, d).select(F.lit("store").alias("kind"), F.col("store_id").alias("id"), F.col("store_name").alias("name"), F.col("category").alias("detail"))
    return s.unionByName(S.products(spark, d).select(F.lit("product").alias("kind"), F.col("product_id").alias("id"), F.col("product_name").alias("name"), F.col("product_category").alias("detail")))


@query(
    "P01_P08_normalized_fields",
    BASE_SQL + "SELECT order_id, CAST(date AS VARCHAR) AS date, store_id, product_id, CAST(qty AS DOUBLE) AS qty, CAST(amount_cents AS DOUBLE) AS amount_cents, payment, is_refund, amount_status, amount_cents / 100.0 AS yuan, CAST(CASE WHEN qty > 0 AND unit_price IS NOT NULL THEN CAST(unit_price * 100 AS BIGINT) * qty END AS DOUBLE) AS list_cents FROM flagged",
)
def p01(spark, d):
    lines = C.with_prices(parsed_of(spark, d), S.products(spark, d))
    return lines.select("order_id", F.col("date").cast("string").alias("date"), "store_id", "product_id", F.col("qty").cast("double").alias("qty"), F.col("amount_cents").cast("double").alias("amount_cents"), "payment", "is_refund", "amount_status", N.yuan("amount_cents").alias("yuan"), N.backfill_cents(F.col("qty"), F.col("unit_price")).cast("double").alias("list_cents"))


@query("P11_net_by_caliber", BASE_SQL + "SELECT store_id, CAST(sum(CASE WHEN reject_v3 IS NULL THEN amount_cents END) AS DOUBLE) AS v3, CAST(sum(CASE WHEN reject_v2 IS NULL THEN coalesce(amount_cents, backfilled_cents) END) AS DOUBLE) AS v2 FROM lines GROUP BY store_id")
def p11(spark, d):
    return lines_of(spark, d).groupBy("store_id").agg(F.sum(F.when(F.col("reject_v3").isNull(), N.net_cents("v3"))).cast("double").alias("v3"), F.sum(F.when(F.col("reject_v2").isNull(), N.net_cents("v2"))).cast("double").alias("v2"))


@query("F01_reject_rules", BASE_SQL + "SELECT r AS rule, count(*) AS n FROM flagged GROUP BY r")
def f01(spark, d):
    return flagged_of(spark, d).groupBy(F.col("reject").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("F02_F04_filtered_lines", BASE_SQL + f"SELECT order_id, CAST(date AS VARCHAR) AS date, CAST(amount_cents AS DOUBLE) AS amount_cents FROM lines WHERE reject_v2 IS NULL AND {WINDOW_SQL} AND store_id = 'S7'")
def f02(spark, d):
    return C.within(C.kept(lines_of(spark, d), "v2"), START, END, " s7 ").select("order_id", F.col("date").cast("string").alias("date"), F.col("amount_cents").cast("double").alias("amount_cents"))


_LINES = "order_id, CAST(date AS VARCHAR) AS date, store_id, product_id, CAST(qty AS DOUBLE) AS qty, CAST(amount_cents AS DOUBLE) AS amount_cents, payment, is_refund, reject_v3, reject_v2, CAST(backfilled_cents AS DOUBLE) AS backfilled_cents, raw_date, raw_qty, raw_amount"


@query("S10_U01_clean_lines", BASE_SQL + f"SELECT {_LINES} FROM lines")
def s10(spark, d):
    # The result is the clean table itself: it is not written beside it.
    return cleaned(spark, d).selectExpr(*[c.strip().replace("VARCHAR", "STRING") for c in _LINES.split(",")])


@query("F05_F06_reject_codes", BASE_SQL + "SELECT reject_v3, reject_v2, count(*) AS n, CAST(sum(amount_cents) AS DOUBLE) AS cents FROM lines GROUP BY ALL")
def f05(spark, d):
    return lines_of(spark, d).groupBy("reject_v3", "reject_v2").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").cast("double").alias("cents"))


@query("J01_J02_unknown_keys", BASE_SQL + "SELECT 'store' AS kind, store_id AS id, count(*) AS n FROM parsed WHERE store_id NOT IN (SELECT store_id FROM stores) GROUP BY store_id UNION ALL SELECT 'product', product_id, count(*) FROM parsed WHERE product_id NOT IN (SELECT product_id FROM products) GROUP BY product_id")
def j01(spark, d):
    return unknown_of(spark, d)


@query("J03_price_backfill", BASE_SQL + "SELECT order_id, product_id, backfilled_cents FROM lines WHERE backfilled_cents IS NOT NULL")
def j03(spark, d):
    return lines_of(spark, d).where("backfilled_cents is not null").select("order_id", "product_id", "backfilled_cents")


@query("W01_W02_duplicate_groups", BASE_SQL + "SELECT order_id, store_id, product_id, count(*) AS copies FROM flagged WHERE r IS NULL GROUP BY order_id, CAST(date AS VARCHAR), store_id, product_id, qty, amount_cents, payment HAVING count(*) > 1")
def w01(spark, d):
    # Every copy but the first of its key was rejected by rule 6.
    later = lines_of(spark, d).where(F.col("reject_v3") == C.RULES[5])
    return later.groupBy(*C.DUP_KEY).agg((F.count(F.lit(1)) + 1).alias("copies")).select("order_id", "store_id", "product_id", "copies")


_RULES_SQL = ", ".join(f"count(*) FILTER (WHERE reject_v3 = '{r}') AS removed_{r[0]}" for r in C.RULES)


@query(
    "A13_A14_cleaning_report",
    BASE_SQL + f"SELECT count(*) AS raw_rows, count(*) FILTER (WHERE reject_v3 IS NULL) AS kept_rows, count(*) FILTER (WHERE reject_v3 IS NULL AND is_refund = 0) AS kept_sales_rows, count(*) FILTER (WHERE reject_v3 IS NULL AND is_refund = 1) AS kept_refund_rows, {_RULES_SQL}, "
    "count(*) FILTER (WHERE reject_v3 = '2_empty_amount' AND amount_status = 'bad') AS unparseable_amounts, count(*) FILTER (WHERE backfilled_cents IS NOT NULL) AS v2_backfilled_rows, count(*) FILTER (WHERE reject_v2 = 'v2_refund_excluded') AS v2_refund_rows, count(*) FILTER (WHERE reject_v2 IS NULL) AS v2_kept_rows, true AS conserved FROM lines",
)
def a13(spark, d):
    return C.report(lines_of(spark, d))


@query("S11_reject_audit", BASE_SQL + """SELECT reject_v3 AS rule, '{"order_id":"' || order_id || '","raw_date":"' || raw_date || '","store_id":"' || store_id || '","product_id":"' || product_id || '","raw_qty":"' || raw_qty || '","raw_amount":"' || raw_amount || '","payment":"' || payment || '"}' AS line_snapshot FROM lines WHERE reject_v3 IS NOT NULL""")
def s11(spark, d):
    return C.audit(lines_of(spark, d))


@query("A01_metric_summary", BASE_SQL + f"SELECT month, store_id, {SHAPE_SQL} FROM ({sums_sql('month, store_id', f'''(SELECT *, strftime(date, '%Y-%m') AS month FROM clean WHERE {WINDOW_SQL})''')})")
def a01(spark, d):
    lines = lines_of(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))
    return M.summary(lines, START, END, by=["month", "store_id"])


@query("A01_metric_summary_v2", BASE_SQL + f"SELECT {SHAPE_SQL} FROM ({sums_sql('', f'(SELECT *, coalesce(amount_cents, backfilled_cents) AS c FROM lines WHERE reject_v2 IS NULL AND {WINDOW_SQL})', 'c')})")
def a01v2(spark, d):
    return M.summary(lines_of(spark, d), START, END, caliber="v2")


@query("A02_J06_daily_metrics", BASE_SQL + f"SELECT CAST(day AS VARCHAR) AS date, coalesce(net_cents, 0) / 100.0 AS net_revenue, coalesce(orders, 0) AS orders, {AOV_SQL} AS aov FROM (SELECT CAST(range AS DATE) AS day FROM range(DATE '1998-01-01', DATE '1999-02-01', INTERVAL 1 DAY)) LEFT JOIN ({sums_sql('date')}) ON day = date")
def a02(spark, d):
    return M.daily(lines_of(spark, d), "1998-01-01", "1999-01-31").withColumn("date", F.col("date").cast("string"))


@query(
    "A03_payment_mix",
    BASE_SQL + f", total AS (SELECT orders AS all_orders, net_cents AS all_cents FROM ({sums_sql('', f'(SELECT * FROM clean WHERE {WINDOW_SQL})')})) SELECT payment, orders, qty, net_cents / 100.0 AS net_revenue, CASE WHEN all_orders <> 0 THEN round(orders / all_orders, 6) ELSE 0.0 END AS share_orders, CASE WHEN all_cents <> 0 THEN round(net_cents / all_cents, 6) ELSE 0.0 END AS share_revenue FROM ({sums_sql('payment', f'(SELECT * FROM clean WHERE {WINDOW_SQL})')}), total",
)
def a03(spark, d):
    return M.payment_mix(lines_of(spark, d), START, END)


@query("A04_product_totals", BASE_SQL + f"SELECT product_id, net_cents, net_cents / 100.0 AS net_revenue, orders, qty FROM ({sums_sql('product_id', f'(SELECT * FROM clean WHERE {WINDOW_SQL})')})")
def a04(spark, d):
    return M.product_totals(lines_of(spark, d), START, END)


@query("K01_J04_top_products", BASE_SQL + f"SELECT t.product_id, product_name, product_category, net_cents / 100.0 AS net_revenue, orders, qty FROM ({sums_sql('product_id', f'(SELECT * FROM clean WHERE {WINDOW_SQL})')} ORDER BY net_cents DESC, product_id LIMIT 10) t LEFT JOIN products p ON t.product_id = p.product_id")
def k01(spark, d):
    return M.top_products(lines_of(spark, d), S.products(spark, d), START, END)


@query("A05_J05_by_store", BASE_SQL + f"SELECT store_id, store_name, category, district, {SHAPE_SQL} FROM (SELECT s.*, coalesce(net_cents, 0) AS net_cents, coalesce(refund_cents, 0) AS refund_cents, coalesce(orders, 0) AS orders, coalesce(qty, 0) AS qty FROM stores s LEFT JOIN ({sums_sql('store_id', '''(SELECT * FROM clean WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-01-07')''')}) c ON s.store_id = c.store_id)")
def a05(spark, d):
    return M.by_store(lines_of(spark, d), S.stores(spark, d), "1995-01-01", "1995-01-07")


_CATEGORY_SQL = f"SELECT category, string_agg(s.store_id, ',' ORDER BY s.store_id) AS stores, CAST(coalesce(sum(net_cents), 0) AS BIGINT) AS net_cents, CAST(coalesce(sum(refund_cents), 0) AS BIGINT) AS refund_cents, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders, CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty FROM stores s LEFT JOIN ({sums_sql('store_id', f'(SELECT * FROM clean WHERE {WINDOW_SQL})')}) c ON s.store_id = c.store_id GROUP BY category"


@query("A06_by_store_category", BASE_SQL + f"SELECT category, stores, {SHAPE_SQL} FROM ({_CATEGORY_SQL})")
def a06(spark, d):
    return M.by_store_category(lines_of(spark, d), S.stores(spark, d), START, END)


@query("K02_categories_ranked", BASE_SQL + f"SELECT category, net_cents / 100.0 AS net_revenue, CAST(row_number() OVER (ORDER BY net_cents DESC, category) AS INTEGER) AS rank FROM ({_CATEGORY_SQL})")
def k02(spark, d):
    return M.ranked(M.by_store_category(lines_of(spark, d), S.stores(spark, d), START, END), "category").select("category", "net_revenue", "rank")


@query("A07_first_sale", BASE_SQL + "SELECT product_id, CAST(min(date) AS VARCHAR) AS first_date FROM clean WHERE is_refund = 0 GROUP BY product_id")
def a07(spark, d):
    return M.first_sales(lines_of(spark, d), ["product_id"]).withColumn("first_date", F.col("first_date").cast("string"))


@query("T39_first_month", BASE_SQL + """SELECT store_id, CAST(CAST(date_trunc('month', min(date)) AS DATE) AS VARCHAR) AS start, CAST(last_day(min(date)) AS VARCHAR) AS "end" FROM clean WHERE is_refund = 0 GROUP BY store_id""")
def t39(spark, d):
    return M.first_month(lines_of(spark, d), ["store_id"]).select("store_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


_PRICE_SQL = f"(SELECT *, CASE WHEN (2 * amount_cents) % (2 * qty) = qty AND (amount_cents // qty) % 2 = 0 THEN amount_cents // qty ELSE (2 * amount_cents + qty) // (2 * qty) END AS price FROM clean WHERE is_refund = 0 AND qty > 0 AND {WINDOW_SQL})"


@query("A08_price_distribution", BASE_SQL + f"SELECT product_id, store_id, price / 100.0 AS price, count(*) AS n FROM {_PRICE_SQL} GROUP BY product_id, store_id, price")
def a08(spark, d):
    return M.price_distribution(lines_of(spark, d), START, END, by_store=True)


@query("K07_mode_price", BASE_SQL + f"SELECT product_id, store_id, price / 100.0 AS price FROM (SELECT product_id, store_id, price, row_number() OVER (PARTITION BY product_id, store_id ORDER BY count(*) DESC, price DESC) AS i FROM {_PRICE_SQL} GROUP BY product_id, store_id, price) WHERE i = 1")
def k07(spark, d):
    return M.mode_price(lines_of(spark, d), START, END)


@query("A09_latest_price", BASE_SQL + f"SELECT t.product_id, n AS rows, CAST(date AS VARCHAR) AS latest_date, price / 100.0 AS latest_price, CAST(p.unit_price AS DOUBLE) AS table_price, abs(CAST(p.unit_price AS DOUBLE) - price / 100.0) > 0.005 AS stale FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n, row_number() OVER (PARTITION BY product_id ORDER BY date DESC, amount_cents DESC, order_id DESC, price DESC) AS i FROM {_PRICE_SQL}) t LEFT JOIN products p ON t.product_id = p.product_id WHERE i = 1")
def a09(spark, d):
    return M.latest_price(lines_of(spark, d), S.products(spark, d), START, END).withColumn("latest_date", F.col("latest_date").cast("string"))


_A, _B = ("1995-01-01", "1995-06-30"), ("1995-07-01", "1995-12-31")
_PERIODS = ", ".join(f"{n} AS (SELECT payment, {SHAPE_SQL} FROM ({sums_sql('payment', f'''(SELECT * FROM clean WHERE date BETWEEN DATE '{w[0]}' AND DATE '{w[1]}')''')}))" for n, w in (("pa", _A), ("pb", _B)))
_LONG = " UNION ALL ".join(f"SELECT pa.payment, '{m}' AS metric, CAST(pa.{m} AS DOUBLE) AS before, CAST(pb.{m} AS DOUBLE) AS after FROM pa JOIN pb ON pa.payment = pb.payment" for m in M.METRICS)


@query("A10_J07_compare_periods", BASE_SQL + f", {_PERIODS}, long AS ({_LONG}), d AS (SELECT *, (round(after * 100) - round(before * 100)) / 100.0 AS delta FROM long) SELECT *, CASE WHEN before <> 0 THEN round(delta / before * 100, 2) END AS pct, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' WHEN delta = 0 THEN 'flat' ELSE 'unknown' END AS direction FROM d")
def a10(spark, d):
    return M.compare_periods(lines_of(spark, d), _A, _B, ["payment"])


@query("A11_kept_rows", BASE_SQL + "SELECT count(*) FILTER (WHERE reject_v3 IS NULL) AS v3, count(*) FILTER (WHERE reject_v2 IS NULL) AS v2 FROM lines")
def a11(spark, d):
    return M.kept_rows(lines_of(spark, d))


@query("A12_data_period", BASE_SQL + "SELECT CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM clean")
def a12(spark, d):
    return M.data_period(lines_of(spark, d)).select(F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"))


@query("A15_zero_days", BASE_SQL + "SELECT CAST(day AS VARCHAR) AS date FROM (SELECT CAST(range AS DATE) AS day FROM range(DATE '1998-01-01', DATE '1999-02-01', INTERVAL 1 DAY)) LEFT JOIN (SELECT date, sum(amount_cents) AS c FROM clean WHERE store_id = 'S3' GROUP BY date) ON day = date WHERE coalesce(c, 0) = 0")
def a15(spark, d):
    return M.zero_days(lines_of(spark, d), "1998-01-01", "1999-01-31", "S3").select(F.col("date").cast("string").alias("date"))


@query("A16_previous_window", BASE_SQL + "SELECT store_id, CAST(coalesce(sum(CASE WHEN date >= DATE '1996-03-01' THEN amount_cents END), 0) AS BIGINT) / 100.0 AS net_revenue, CAST(coalesce(sum(CASE WHEN date < DATE '1996-03-01' THEN amount_cents END), 0) AS BIGINT) / 100.0 AS previous_net_revenue FROM clean WHERE date BETWEEN DATE '1996-03-01' - 31 AND DATE '1996-03-31' GROUP BY store_id")
def a16(spark, d):
    return M.previous_window(lines_of(spark, d), "1996-03-01", "1996-03-31", ["store_id"])


@query("A27_metrics_unchanged", BASE_SQL + f"SELECT payment, true AS unchanged FROM clean WHERE {WINDOW_SQL} GROUP BY payment")
def a27(spark, d):
    lines = lines_of(spark, d)
    return M.unchanged(M.summary(lines, START, END, by=["payment"]), M.summary(lines, START, END, by=["payment"]), ["payment"])


@query("F14_data_period_gate", BASE_SQL + """, w AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) + 1460 AS s FROM orders) SELECT CAST(s AS VARCHAR) AS start, CAST(s + 30 AS VARCHAR) AS "end", s <= (SELECT max(date) FROM clean) AND s + 30 >= (SELECT min(date) FROM clean) AS in_period FROM w""")
def f14(spark, d):
    start = F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "year"), 1460)
    windows = spark.read.parquet(f"{d}/orders.parquet").select(start.alias("start")).distinct().withColumn("end", F.date_add("start", 30))
    return M.gated(windows, M.data_period(lines_of(spark, d))).select(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "in_period")
