"""One family of metrics over clean lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import half_up_cents, net_cents, yuan
from ..sources.scratch import written
from .cleaning import kept, within

METRICS = ["net_revenue", "refund_amount", "orders", "aov", "qty"]


def _sums(caliber: str) -> list[Column]:
    cents, refund = net_cents(caliber), F.col("is_refund") == 1
    return [
        F.coalesce(F.sum(cents), F.lit(0)).alias("net_cents"),
        F.coalesce(F.sum(F.when(refund, -cents)), F.lit(0)).alias("refund_cents"),
        F.count_distinct(F.when(~refund, F.col("order_id"))).alias("orders"),
        F.coalesce(F.sum(F.when(refund, -F.col("qty")).otherwise(F.col("qty"))), F.lit(0)).alias("qty"),
    ]


def _shaped(sums: DataFrame, by: list[str]) -> DataFrame:
    aov = half_up_cents(F.col("net_cents"), F.col("orders"))
    return sums.select(*by, yuan("net_cents").alias("net_revenue"), yuan("refund_cents").alias("refund_amount"), "orders", yuan(aov).alias("aov"), "qty")


def cents(lines: DataFrame, by: list[str], caliber: str = "v3") -> DataFrame:
    """Sums in cents by any columns: one shuffle, one distinct count."""
    rows = kept(lines, caliber)
    return (rows.groupBy(*by) if by else rows).agg(*_sums(caliber))


def summary(lines: DataFrame, start: str, end: str, store_id: str | None = None, product_id: str | None = None, caliber: str = "v3", by: list[str] | None = None) -> DataFrame:
    """The five metrics of a closed window; without ``by`` one row, zeros and a null aov where it is empty."""
    return _shaped(cents(within(lines, start, end, store_id, product_id), by or [], caliber), by or [])


def daily(lines: DataFrame, start: str, end: str, store_id: str | None = None, product_id: str | None = None, caliber: str = "v3") -> DataFrame:
    """One row a calendar day, zeros where nothing sold."""
    spine = lines.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    got = cents(within(lines, start, end, store_id, product_id), ["date"], caliber)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = spine.join(got.hint("merge"), F.col("day") == F.col("date"), "left").select(F.col("day").alias("date"), zero("net_cents"), zero("refund_cents"), zero("orders"), zero("qty"))
    return _shaped(joined, ["date"]).select("date", "net_revenue", "orders", "aov")


def payment_mix(lines: DataFrame, start: str, end: str, store_id: str | None = None, caliber: str = "v3") -> DataFrame:
    """Orders, quantity, net and shares by payment; v2 is not filled in here. The order total is distinct over all payments."""
    rows = kept(within(lines, start, end, store_id), caliber)
    groups = rows.groupBy("payment").agg(*_sums("v3"))
    total = cents(within(lines, start, end, store_id), [], caliber).select(F.col("orders").alias("all_orders"), F.col("net_cents").alias("all_cents"))
    both = groups.crossJoin(F.broadcast(total))  # one row
    share = lambda a, b: F.when(b != 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    return both.select("payment", "orders", "qty", yuan("net_cents").alias("net_revenue"), share(F.col("orders"), F.col("all_orders")).alias("share_orders"), share(F.col("net_cents"), F.col("all_cents")).alias("share_revenue"))


def product_totals(lines: DataFrame, start: str, end: str, store_id: str | None = None, caliber: str = "v3") -> DataFrame:
    """Net, orders and quantity of each product, not filled in under v2."""
    rows = kept(within(lines, start, end, store_id), caliber)
    return rows.groupBy("product_id").agg(*_sums("v3")).select("product_id", "net_cents", yuan("net_cents").alias("net_revenue"), "orders", "qty")


def top_products(lines: DataFrame, products: DataFrame, start: str, end: str, limit: int = 10, store_id: str | None = None, caliber: str = "v3") -> DataFrame:
    """Products by net, ties by id, with their names; at least one row is asked for."""
    best = product_totals(lines, start, end, store_id, caliber).orderBy(F.desc("net_cents"), "product_id").limit(max(1, limit))
    # ``limit`` rows: broadcast to the products, each of which is read once.
    return products.select("product_id", "product_name", "product_category").join(F.broadcast(best), "product_id", "right").select("product_id", "product_name", "product_category", "net_revenue", "orders", "qty")


def by_store(lines: DataFrame, stores: DataFrame, start: str, end: str, product_id: str | None = None, caliber: str = "v3") -> DataFrame:
    """The five metrics of every store, those without sales too, in one grouping."""
    got = cents(within(lines, start, end, None, product_id), ["store_id"], caliber)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    names = ["store_id", "store_name", "category", "district"]
    return _shaped(stores.join(got.hint("merge"), "store_id", "left").select(*names, zero("net_cents"), zero("refund_cents"), zero("orders"), zero("qty")), names)


def by_store_category(lines: DataFrame, stores: DataFrame, start: str, end: str, caliber: str = "v3") -> DataFrame:
    """Sums of store values by category; orders add across stores, the aov is recomputed."""
    got = cents(within(lines, start, end), ["store_id"], caliber)
    joined = stores.select("store_id", "category").join(got.hint("merge"), "store_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = joined.groupBy("category").agg(total("net_cents"), total("refund_cents"), total("orders"), total("qty"), F.array_join(F.sort_array(F.collect_list("store_id")), ",").alias("stores"))
    return _shaped(sums, ["category", "stores"])


def ranked(frame: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Rows by net, ties by key. Ranges of the order are numbered by themselves and start where those before them end."""
    order = [F.desc("net_revenue"), F.asc(key)]
    placed = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_first", before.alias("_before"))
    # One row a range, so bounded by the number of shuffle partitions.
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_part", "_at", "_first", "_before")


def first_sales(lines: DataFrame, by: list[str]) -> DataFrame:
    """The first day with a sale (no refunds), v3."""
    return kept(lines).where("is_refund = 0").groupBy(*by).agg(F.min("date").alias("first_date"))


def first_month(lines: DataFrame, by: list[str]) -> DataFrame:
    """The calendar month of the first sale as a closed window."""
    return first_sales(lines, by).select(*by, F.trunc("first_date", "month").alias("start"), F.last_day("first_date").alias("end"))


def _priced(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Unit prices in cents, halves to even, of sales rows."""
    rows = kept(within(lines, start, end)).where("is_refund = 0 AND qty > 0")
    return rows.withColumn("price", F.bround(F.col("amount_cents").cast("decimal(20,0)") / F.col("qty").cast("decimal(20,0)"), 0).cast("long"))


def price_distribution(lines: DataFrame, start: str, end: str, by_store: bool = False) -> DataFrame:
    """How often each unit price was charged, by product or by product and store."""
    keys = ["product_id", *(["store_id"] if by_store else []), "price"]
    return _priced(lines, start, end).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("price", yuan("price"))


def mode_price(lines: DataFrame, start: str, end: str) -> DataFrame:
    """The most frequent price of a product in a store, the higher of equals."""
    return price_distribution(lines, start, end, True).groupBy("product_id", "store_id").agg(F.max_by("price", F.struct("n", "price")).alias("price"))


def latest_price(lines: DataFrame, products: DataFrame, start: str, end: str) -> DataFrame:
    """The price of the last sale (by day, amount, order) against the list price, stale beyond half a cent."""
    last = _priced(lines, start, end).groupBy("product_id").agg(F.max_by(F.struct("date", "price"), F.struct("date", "amount_cents", "order_id", "price")).alias("l"), F.count(F.lit(1)).alias("rows"))
    both = last.join(products.select("product_id", "unit_price").hint("merge"), "product_id", "left")
    listed = F.col("unit_price").cast("double")
    return both.select("product_id", "rows", F.col("l.date").alias("latest_date"), yuan("l.price").alias("latest_price"), listed.alias("table_price"), (F.abs(listed - yuan("l.price")) > 0.005).alias("stale"))


def compare_periods(lines: DataFrame, a: tuple[str, str], b: tuple[str, str], by: list[str], caliber: str = "v3") -> DataFrame:
    """Rounded metrics of two windows, their difference, its percentage and direction, one row a metric."""
    left, right = (summary(lines, *w, caliber=caliber, by=by) for w in (a, b))
    joined = left.select(*by, *(F.col(m).cast("double").alias(f"{m}_a") for m in METRICS)).join(right.select(*by, *(F.col(m).cast("double").alias(f"{m}_b") for m in METRICS)).hint("merge"), by, "inner")
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("before"), F.col(f"{m}_b").alias("after")) for m in METRICS))
    long = joined.select(*by, F.explode(pairs).alias("m")).select(*by, "m.*")
    # Cents first: the difference of two rounded amounts is exact there.
    delta = (F.round(F.col("after") * 100) - F.round(F.col("before") * 100)) / 100.0
    pct = F.when(F.col("before") != 0, F.round(delta / F.col("before") * 100, 2))
    way = F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat").otherwise("unknown")
    return long.select(*by, "metric", "before", "after", delta.alias("delta"), pct.alias("pct"), way.alias("direction"))


def kept_rows(lines: DataFrame) -> DataFrame:
    """Valid rows by caliber."""
    return lines.agg(F.count_if(F.col("reject_v3").isNull()).alias("v3"), F.count_if(F.col("reject_v2").isNull()).alias("v2"))


def data_period(lines: DataFrame) -> DataFrame:
    """First and last kept day."""
    return kept(lines).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def zero_days(lines: DataFrame, start: str, end: str, store_id: str | None = None) -> DataFrame:
    """Days of a window without net revenue."""
    return daily(lines, start, end, store_id).where("net_revenue = 0").select("date")


def previous_window(lines: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """Net of a window and of the equally long one before it, in one pass."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    length = F.datediff(e, s) + 1
    rows = kept(lines).where(F.col("date").between(F.date_sub(s, length), e))
    now = F.col("date") >= s
    total = lambda test: yuan(F.coalesce(F.sum(F.when(test, F.col("amount_cents"))), F.lit(0)))
    return rows.groupBy(*by).agg(total(now).alias("net_revenue"), total(~now).alias("previous_net_revenue"))


def unchanged(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe comparison of two metric tables, one row a key."""
    b = after.select(*by, *(F.col(m).alias(f"{m}_2") for m in METRICS))
    same = F.lit(True)
    for m in METRICS:
        same = same & F.col(m).eqNullSafe(F.col(f"{m}_2"))
    return before.join(b.hint("merge"), by, "full_outer").select(*by, same.alias("unchanged"))


def gated(windows: DataFrame, period: DataFrame) -> DataFrame:
    """windows (start, end) with whether they meet the data's one-row period."""
    near = windows.crossJoin(F.broadcast(period))
    return near.withColumn("in_period", (F.col("start") <= F.col("last_date")) & (F.col("end") >= F.col("first_date"))).drop("first_date", "last_date")
