"""Cleaning of sales facts under ordered rules.

Whole lines are not shuffled for the dimensions: their ids are counted, those that no dimension has are
marked on the lines, and only lines of rule 2 meet the list prices. Of the rows that pass rules 1 to 5
only those whose key stands twice enter the shuffle of rule 6. ``flag`` and ``clean_flagged`` read their
lines several times: give them written tables and fields are parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import amount_status, backfill_cents, norm_id, parse_amount_cents, parse_date, parse_qty, refund_flag
from ..sources.scratch import few, written

#: The reject codes, in the order of the rules.
RULES = ["1_unparseable_date", "2_empty_amount", "3_qty_le_zero", "4_store_not_in_stores", "5_product_not_in_products", "6_duplicate_row", "7_zero_amount"]
V2_REFUND = "v2_refund_excluded"
#: Names of keys that stand twice or more (some 50 bytes each): up to so many are broadcast to the lines.
BROADCAST_NAMES = 4_000_000
#: Dimensions of up to so many rows (some 100 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
DUP_KEY = ["order_id", "date", "store_id", "product_id", "qty", "amount_cents", "payment"]


def parse_lines(raw: DataFrame) -> DataFrame:
    """Typed columns beside the raw ones."""
    return raw.select(
        norm_id("order_id").alias("order_id"),
        parse_date("date").alias("date"),
        norm_id("store_id").alias("store_id"),
        norm_id("product_id").alias("product_id"),
        parse_qty("qty").alias("qty"),
        parse_amount_cents("amount").alias("amount_cents"),
        norm_id("payment").alias("payment"),
        refund_flag(parse_amount_cents("amount")).alias("is_refund"),
        F.coalesce("date", F.lit("")).alias("raw_date"),
        F.coalesce("qty", F.lit("")).alias("raw_qty"),
        F.coalesce("amount", F.lit("")).alias("raw_amount"),
        amount_status("amount").alias("amount_status"),
    )


def flag_foreign_keys(lines: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Whether the store and the product exist, and the list price."""
    s = stores.select("store_id").distinct().withColumn("known_store", F.lit(True))
    p = products.groupBy("product_id").agg(F.max("unit_price").alias("unit_price")).withColumn("known_product", F.lit(True))
    s, p = (F.broadcast(x) if few(x, BROADCAST_ROWS) else x.hint("merge") for x in (s, p))
    return lines.join(s, "store_id", "left").join(p, "product_id", "left").withColumn("known_store", F.coalesce("known_store", F.lit(False))).withColumn("known_product", F.coalesce("known_product", F.lit(False)))


def first_reject() -> Column:
    """the first of rules 1 to 5 that a row breaks, or null."""
    tests = [F.col("date").isNull(), F.col("amount_cents").isNull(), F.col("qty").isNull() | (F.col("qty") <= 0), ~F.col("known_store"), ~F.col("known_product")]
    out = F.when(tests[0], RULES[0])
    for test, rule in zip(tests[1:], RULES[1:5], strict=True):
        out = out.when(test, rule)
    return out


def unknown_ids(lines: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Kind (store, product), id and the number n of parsed lines with it, of every id that its dimension lacks.

    Lines are counted by id before they meet a dimension: one unknown id may have very many.
    """
    n = lambda c: lines.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    known = lambda ids: ids.withColumn("_known", F.lit(True)).hint("merge")
    # An anti join would be put below the counting where a dimension is small, and shuffle the lines.
    s = n("store_id").join(known(stores.select(F.col("store_id").alias("id"))), "id", "left").where("_known is null")
    p = n("product_id").join(known(products.select(F.col("product_id").alias("id"))), "id", "left").where("_known is null")
    return s.select(F.lit("store").alias("kind"), "id", "n").unionByName(p.select(F.lit("product").alias("kind"), "id", "n"))


def flag_unknown(lines: DataFrame, unknown: DataFrame) -> DataFrame:
    """Whether the store and the product of each line exist, from the rows of ``unknown_ids``, which is read twice or more: give it written."""
    out, hint = lines, "broadcast" if few(unknown, BROADCAST_ROWS) else "merge"
    for kind in ("store", "product"):
        ids = unknown.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.lit(True).alias("_unknown"))
        out = out.join(ids.hint(hint), f"{kind}_id", "left").withColumn(f"known_{kind}", F.col("_unknown").isNull()).drop("_unknown")
    return out


def with_prices(lines: DataFrame, products: DataFrame) -> DataFrame:
    """The list price of each line's product."""
    p = products.groupBy("product_id").agg(F.max("unit_price").alias("unit_price"))
    return lines.join(F.broadcast(p) if few(p, BROADCAST_ROWS) else p.hint("merge"), "product_id", "left")


def number_copies(passed: DataFrame, among: Column | None = None) -> DataFrame:
    """The copy number of each row among rows with equal key, and a stable name of the key; null for rows that are not ``among`` them.

    Names of keys are counted first, and only rows whose name stands twice or more meet by their whole keys: the others are first copies where they lie.
    ``passed`` is read twice more for it: give rows that are written, or cheap.
    """
    among = F.lit(True) if among is None else among
    named = passed.withColumn("dup_group", F.when(among, F.xxhash64(*DUP_KEY)))
    again = written(named.where(among).groupBy("dup_group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dup_group"), "repeated")
    again = F.broadcast(again) if few(again, BROADCAST_NAMES) else again.hint("merge")
    order = Window.partitionBy(*DUP_KEY).orderBy("raw_date", "raw_qty", "raw_amount")
    alone = named.join(again, "dup_group", "left_anti").withColumn("copy", F.when(among, F.lit(1)))
    several = named.join(again, "dup_group", "left_semi").withColumn("copy", F.row_number().over(order))
    return alone.select(*passed.columns, "copy", "dup_group").unionByName(several.select(*passed.columns, "copy", "dup_group"))


def flag(lines: DataFrame, unknown: DataFrame) -> DataFrame:
    """Parsed lines with ``reject``, the first of rules 1 to 5 that each breaks; ``unknown`` has the rows of ``unknown_ids``. No shuffle where they are few."""
    return flag_unknown(lines, unknown).withColumn("reject", first_reject())


def clean(raw: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """All rows, kept and rejected (U01), with reject_v3, reject_v2, backfilled_cents and dup_group."""
    lines = parse_lines(raw)
    return clean_flagged(flag(lines, written(unknown_ids(lines, stores, products), "unknown")), products)


def clean_flagged(flagged: DataFrame, products: DataFrame) -> DataFrame:
    """``clean`` from the rows of ``flag``."""
    empty = F.coalesce(F.col("reject") == RULES[1], F.lit(False))
    lines = number_copies(flagged.where(~empty), F.col("reject").isNull()).withColumn("backfilled_cents", F.lit(None).cast("long"))
    # rule 6 takes later copies, rule 7 a first copy of amount zero.
    lines = lines.withColumn("reject", F.coalesce("reject", F.when(F.col("copy") > 1, RULES[5]).when((F.col("copy") == 1) & (F.col("amount_cents") == 0), RULES[6])))
    filled = with_prices(flagged.where(empty), products).withColumn("backfilled_cents", backfill_cents(F.col("qty"), F.col("unit_price"))).withColumn("dup_group", F.lit(None).cast("long"))
    lines = lines.drop("copy").unionByName(filled.drop("unit_price")).withColumnRenamed("reject", "reject_v3").drop("known_store", "known_product")
    # v2 keeps rows it can fill, and leaves refunds out.
    v2 = F.when(F.col("backfilled_cents").isNull(), F.col("reject_v3"))
    return lines.withColumn("reject_v2", F.coalesce(v2, F.when(F.col("is_refund") == 1, V2_REFUND)))


def kept(lines: DataFrame, caliber: str = "v3") -> DataFrame:
    """the rows that a caliber counts."""
    return lines.where(F.col("reject_v2" if caliber.strip().lower() == "v2" else "reject_v3").isNull())


def within(lines: DataFrame, start: str, end: str, store_id: str | None = None, product_id: str | None = None) -> DataFrame:
    """closed window of days, and a store or a product if named (trimmed, upper case)."""
    out = lines.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for column, value in (("store_id", store_id), ("product_id", product_id)):
        if value and value.strip():
            out = out.where(F.col(column) == value.strip().upper())
    return out


def report(lines: DataFrame) -> DataFrame:
    """One row of counts; fails if kept and removed do not add up to raw."""
    n = lambda test: F.count_if(test)
    code, good = F.col("reject_v3"), F.col("reject_v3").isNull()
    counts = lines.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        n(good).alias("kept_rows"),
        n(good & (F.col("is_refund") == 0)).alias("kept_sales_rows"),
        n(good & (F.col("is_refund") == 1)).alias("kept_refund_rows"),
        *(n(code == rule).alias(f"removed_{rule[0]}") for rule in RULES),
        n((code == RULES[1]) & (F.col("amount_status") == "bad")).alias("unparseable_amounts"),
        n(F.col("backfilled_cents").isNotNull()).alias("v2_backfilled_rows"),
        n(F.col("reject_v2") == V2_REFUND).alias("v2_refund_rows"),
        n(F.col("reject_v2").isNull()).alias("v2_kept_rows"),
    )
    removed = sum(F.col(f"removed_{rule[0]}") for rule in RULES)
    return counts.withColumn("conserved", F.when(F.col("raw_rows") == F.col("kept_rows") + removed, True).otherwise(F.raise_error(F.lit("kept and removed rows do not add up to raw rows"))))


def audit(lines: DataFrame) -> DataFrame:
    """Rule and a JSON snapshot of every rejected row."""
    row = F.to_json(F.struct("order_id", "raw_date", "store_id", "product_id", "raw_qty", "raw_amount", "payment"))
    return lines.where("reject_v3 is not null").select(F.col("reject_v3").alias("rule"), row.alias("line_snapshot"))


def write_clean(lines: DataFrame, path: str) -> None:
    """The clean table, kept and rejected rows, by month."""
    lines.withColumn("month", F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none"))).write.partitionBy("month").mode("overwrite").parquet(path)


def write_audit(lines: DataFrame, path: str) -> None:
    """The audit of rejects, appended."""
    audit(lines).write.mode("append").parquet(path)
