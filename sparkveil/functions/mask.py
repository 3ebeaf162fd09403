"""Masking of log lines and previews: replacements one after the other, not span based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkveil.functions.sql import apply, let, lit, regex

# Pattern and mask, in order.
LOG_MASKS = (
    (r"\b[\w.+-]+@[\w.-]+\.\w+\b", "[EMAIL]"),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE]"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CARD]"),
    (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
)
PREVIEW_MASKS = LOG_MASKS[:3]
LENGTH_ONLY = ("text", "content", "input", "output")


def _chain(x: str, masks: tuple[tuple[str, str], ...]) -> str:
    for pattern, mask in masks:
        x = f"regexp_replace({x}, {regex(pattern)}, {lit(mask)})"
    return x


def mask_log(column: Column | str) -> Column:
    """A log line with addresses, phones, cards, SSNs and dotted quads masked."""
    return apply(column, "x", f"IF(contains(x, '@') OR x RLIKE {regex(r'\d')}, {_chain('x', LOG_MASKS)}, x)")


def safe_preview(column: Column | str, length: int = 100) -> Column:
    """``[N chars] `` and the masked first characters on one line."""
    cut = f"replace(replace(left(x, {length}), '\\n', ' '), '\\r', '')"
    shown = f"concat('[', length(x), ' chars] ', {_chain('p', PREVIEW_MASKS)}, IF(length(x) > {length}, '...', ''))"
    return apply(column, "x", f"IF(x IS NULL OR x = '', '[empty]', {let('p', cut, shown)})")


def safe_details(details: Column | str) -> Column:
    """A map of details with the bulky text fields replaced by their lengths."""
    col = F.col(details) if isinstance(details, str) else details
    bulky = lambda k: k.isin(*LENGTH_ONLY)
    entries = F.transform(
        F.map_entries(col),
        lambda e: F.struct(
            F.when(bulky(e.key), F.concat(e.key, F.lit("_length"))).otherwise(e.key).alias("key"),
            F.when(bulky(e.key), F.coalesce(F.length(e.value), F.lit(0)).cast("string")).otherwise(e.value).alias("value"),
        ),
    )
    return F.map_from_entries(entries)
