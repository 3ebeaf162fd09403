"""Checksums as native expressions."""

from __future__ import annotations

from pyspark.sql import Column

from sparkveil.functions.sql import apply

# Multiplication and permutation tables of the Verhoeff scheme.
_D = "0123456789123406789523401789563401289567401239567859876043216598710432765982104387659321049876543210"
_P = "01234567891576283094580379614289160435279453126870428657390127938064157046913258"


def verhoeff_sql(digits: str) -> str:
    """True when a text of digits passes; NULL-safe, non-digits fail."""
    step = (
        f"CAST(substring('{_D}', 10 * a + 1 + "
        f"CAST(substring('{_P}', 10 * (x.i % 8) + 1 + CAST(x.c AS INT), 1) AS INT), 1) AS INT)"
    )
    walk = (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> named_struct('i', i, 'c', c)), "
        f"0, (a, x) -> {step})"
    )
    return f"IF({digits} RLIKE '^[0-9]+$', {walk} = 0, FALSE)"


def luhn_sql(digits: str) -> str:
    value = (
        "CASE WHEN i % 2 = 0 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 "
        "ELSE 2 * CAST(c AS INT) END"
    )
    total = f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> {value}), 0, (a, x) -> a + x)"
    return f"IF({digits} RLIKE '^[0-9]+$', {total} % 10 = 0, FALSE)"


def verhoeff(column: Column | str) -> Column:
    return apply(column, "y", verhoeff_sql("y"))


def luhn(column: Column | str) -> Column:
    return apply(column, "y", luhn_sql("y"))
