"""Column functions that parse and round sales values."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "０１２３４５６７８９"
#: The signs and blanks that an amount may carry. A comma is none of them.
_CURRENCY = "¥￥ \t\u3000"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def _width_pairs() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form is one other character, and that form."""
    pairs = [(chr(i), unicodedata.normalize("NFKC", chr(i))) for i in range(128, 0xFFFF) if not 0xD800 <= i < 0xE000]
    good = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in good), "".join(b for _, b in good)


def plain_width(c: str | Column) -> Column:
    """Compatibility forms of single characters (full-width digits and letters, circled and raised digits) as plain ones, inside the JVM.

    Characters whose compatibility form has several characters stay; ``operators.corpus.nfkc_lower`` takes those too.
    """
    text = _column(c)
    # Translating looks up every character; most texts have none to change.
    return F.when(text.rlike(r"[^\x00-\x9F¥]"), F.translate(text, *_width_pairs())).otherwise(text)


def norm_id(c: str | Column) -> Column:
    """Trimmed and upper case; null is empty."""
    return F.upper(F.trim(F.coalesce(_column(c), F.lit(""))))


def parse_date(c: str | Column) -> Column:
    """Yyyy-m-d, yyyy/m/d and d-m-yyyy (day first), separators may mix; days that no calendar has give null."""
    text = F.translate(F.translate(F.trim(_column(c)), _WIDE, "0123456789"), "/", "-")
    year_first, day_first = r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$"
    return F.when(text.rlike(year_first), F.try_to_date(text, "yyyy-M-d")).when(text.rlike(day_first), F.try_to_date(text, "d-M-yyyy"))


def _decimal(c: str | Column, drop: str) -> tuple[Column, Column]:
    text = F.translate(F.translate(F.coalesce(_column(c), F.lit("")), drop, ""), _WIDE, "0123456789")
    return text, F.when(~text.contains("_"), text.try_cast("decimal(38,10)"))


def parse_amount_cents(c: str | Column) -> Column:
    """Cents, halves to even; currency signs and blanks are dropped. Null if empty, no number, or beyond a long."""
    _, value = _decimal(c, _CURRENCY)
    return F.bround(F.try_multiply(value, F.lit(100)), 0).try_cast("long")


def amount_status(c: str | Column) -> Column:
    """Ok, empty or bad."""
    text, _ = _decimal(c, _CURRENCY)
    return F.when(text == "", "empty").when(parse_amount_cents(c).isNull(), "bad").otherwise("ok")


def parse_qty(c: str | Column) -> Column:
    """Whole numbers only: 3.0 is 3, 1.5 and what a long cannot hold are null."""
    _, value = _decimal(c, " \t")
    return F.when(value == F.floor(value), value.try_cast("long"))


def yuan(cents: str | Column) -> Column:
    """Cents as a double of whole units."""
    return _column(cents) / F.lit(100.0)


def half_up_cents(total: Column, count: Column) -> Column:
    """Total / count in whole cents, halves away from zero; null when the count is 0. Integers throughout."""
    return F.when(count > 0, F.signum(total).cast("long") * F.floor((2 * F.abs(total) + count) / (2 * count)))


def refund_flag(cents: str | Column) -> Column:
    """1 for negative amounts, else 0 (null too)."""
    return F.coalesce((_column(cents) < 0).cast("int"), F.lit(0))


def backfill_cents(qty: Column, unit_price: Column) -> Column:
    """Quantity times list price in cents (each price's halves to even), for positive quantities with a price."""
    return F.when((qty > 0) & unit_price.isNotNull(), F.try_multiply(F.bround(F.try_multiply(unit_price, F.lit(100)), 0).try_cast("long"), qty))


def net_cents(caliber: str) -> Column:
    """The amount that a caliber sums: v2 fills empty amounts, anything else is v3."""
    return F.coalesce("amount_cents", "backfilled_cents") if caliber.strip().lower() == "v2" else F.col("amount_cents")
