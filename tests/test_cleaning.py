"""The cleaning cases, one rule each, and the invariants of the report."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import normalize as N
from ledgerlark.operators import cleaning as C
from ledgerlark.operators import metrics as M

BASE = {"order_id": "ORD1", "date": "2026-07-01", "store_id": "S91", "product_id": "P91", "qty": "2", "amount": "30.00", "payment": "cash"}
CASES = [
    ({}, None, 3000),
    ({"store_id": " s91 "}, None, 3000),
    ({"product_id": " p91"}, None, 3000),
    ({"date": "2026/7/1"}, None, 3000),
    ({"date": "07-06-2026"}, None, 3000),
    ({"date": "2026-6/5"}, None, 3000),
    ({"amount": "¥38.00"}, None, 3800),
    ({"amount": "￥38.00"}, None, 3800),
    ({"amount": "-12.00"}, None, -1200),
    ({"date": "2026-13-45"}, "1_unparseable_date", 3000),
    ({"date": "2026-02-31"}, "1_unparseable_date", 3000),
    ({"amount": ""}, "2_empty_amount", None),
    ({"amount": "1_000"}, "2_empty_amount", None),
    ({"amount": "1,234.00"}, "2_empty_amount", None),
    ({"amount": "1,2,3"}, "2_empty_amount", None),
    ({"amount": "\u300038.00 "}, None, 3800),
    ({"amount": "9" * 20}, "2_empty_amount", None),
    ({"amount": "9" * 29}, "2_empty_amount", None),
    ({"qty": "12345678901234567890"}, "3_qty_le_zero", 3000),
    ({"qty": "9" * 18, "amount": ""}, "2_empty_amount", None),
    ({"qty": "0"}, "3_qty_le_zero", 3000),
    ({"qty": "1.5"}, "3_qty_le_zero", 3000),
    ({"qty": "3.0"}, None, 3000),
    ({"store_id": "S00"}, "4_store_not_in_stores", 3000),
    ({"product_id": "P00"}, "5_product_not_in_products", 3000),
    ({"amount": "0"}, "7_zero_amount", 0),
    ({"date": None, "amount": None}, "1_unparseable_date", None),
]


@pytest.fixture(scope="module")
def dims(spark):
    return (
        spark.createDataFrame([("S91",), ("S92",)], "store_id string"),
        spark.createDataFrame([("P91", 12.5), ("P92", 25.0)], "product_id string, unit_price double").withColumn("unit_price", F.col("unit_price").cast("decimal(12,2)")),
    )


def facts(spark, rows):
    names = list(BASE)
    return spark.createDataFrame([tuple((BASE | r)[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def test_cases(spark, dims):
    rows = [change | {"order_id": f"ORD{i}"} for i, (change, _, _) in enumerate(CASES)]
    got = {r.order_id: r for r in C.clean(facts(spark, rows), *dims).collect()}
    for i, (_, reject, cents) in enumerate(CASES):
        assert (got[f"ORD{i}"].reject_v3, got[f"ORD{i}"].amount_cents) == (reject, cents), CASES[i]


def test_day_first_and_copies(spark, dims):
    lines = C.clean(facts(spark, [{"date": "07-06-2026"}, {}, {}, {"product_id": "P92"}]), *dims)
    assert sorted(str(r.date) for r in lines.where("reject_v3 is null").collect()) == ["2026-06-07", "2026-07-01", "2026-07-01"]
    assert lines.where("reject_v3 = '6_duplicate_row'").count() == 1
    one = M.summary(lines, "2026-07-01", "2026-07-01").first()
    assert (one.net_revenue, one.orders, one.qty) == (60.0, 1, 4)


def test_report_conserves(spark, dims):
    report = C.report(C.clean(facts(spark, [c for c, _, _ in CASES]), *dims)).first()
    assert report.conserved and report.raw_rows == len(CASES)
    assert report.v2_backfilled_rows == 6 and report.unparseable_amounts == 5


def test_empty_window_and_zero_days(spark, dims):
    lines = C.clean(facts(spark, [{}]), *dims)
    row = M.summary(lines, "2030-01-01", "2030-01-31").first()
    assert (row.net_revenue, row.refund_amount, row.orders, row.aov, row.qty) == (0.0, 0.0, 0, None, 0)
    assert M.daily(lines, "2026-06-30", "2026-07-02").count() == 3
    assert M.zero_days(lines, "2026-06-30", "2026-07-02").count() == 2


def test_rounding(spark):
    row = spark.range(1).select(N.parse_amount_cents(F.lit("0.125")).alias("even"), N.parse_amount_cents(F.lit("0.135")).alias("up"), N.half_up_cents(F.lit(5), F.lit(2)).alias("half")).first()
    assert (row.even, row.up, row.half) == (12, 14, 3)


def test_empty_table(spark, dims):
    empty = facts(spark, [{}]).limit(0)
    assert C.report(C.clean(empty, *dims)).first().raw_rows == 0
