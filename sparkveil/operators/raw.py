"""Findings and redaction in the places of the raw text.

Detection reads the cleaned text; these operators carry each finding back to where it stands in the
text as it was given, so that everything outside the findings stays as it is, byte for byte. Like
the other redaction operators they are narrow: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions import spans as S
from sparkveil.functions.align import align_stages, traced_span_sql
from sparkveil.functions.sql import let
from sparkveil.operators import redaction
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.words import NameLists

_ALIGNED, _FOUND, _BOTH = "__aligned", "__found", "__both"


def aligned(df: DataFrame, column: str, out: str = "aligned", config: RedactionConfig | None = None) -> DataFrame:
    """Add ``struct<text, starts, ends>``: the cleaned text, and for each of its characters where it
    begins and ends in the raw text. Null for null and blank texts."""
    stages = [*align_stages(config), "named_struct('text', s.t, 'starts', coalesce(s.b, sequence(0, length(s.t) - 1)), 'ends', coalesce(s.e, sequence(1, length(s.t))))"]
    return redaction.run_stages(df, {out: column}, stages)


def _carried(df: DataFrame, column: str, config: RedactionConfig | None, names: NameLists | None) -> DataFrame:
    """`df` with the traced text and its findings, side by side in one column."""
    config = (config or RedactionConfig()).repaired()
    both = redaction.run_stages(df, {_ALIGNED: column}, align_stages(config, traced=True))
    # the traced text is the cleaned one, so it is not cleaned a second time
    both = both.withColumn(_FOUND, F.col(f"{_ALIGNED}.t"))
    both = redaction.with_findings(both, _FOUND, config.with_(enable_data_cleaning=False), names, out=_FOUND)
    return both.withColumn(_BOTH, F.expr(f"IF({_ALIGNED} IS NULL, NULL, named_struct('x', {_ALIGNED}.x, 'ed', {_ALIGNED}.ed, 'd', {_FOUND}))"))


def findings(
    df: DataFrame,
    column: str,
    keep: Sequence[str] = (),
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
) -> DataFrame:
    """One row per finding, as ``redaction.findings``, with ``raw_start``, ``raw_end`` and ``raw_original``.

    ``substring(raw, raw_start + 1, raw_end - raw_start)`` is ``raw_original``: the characters from
    which ``original`` was cleaned.
    """
    slim = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, column])])
    start, end = traced_span_sql("c.start", "c.end")
    item = (
        "named_struct('original', c.original, 'replacement', c.replacement, 'pi_type', c.pi_type, 'start', c.start, 'end', c.end, "
        "'confidence', c.confidence, 'method', c.method, 'raw_start', rs, 'raw_end', re, 'raw_original', substring(s.x, rs + 1, re - rs))"
    )
    stage = f"transform(s.d, c -> {let('rs', start, let('re', end, item))})"
    rows = _carried(slim, column, config, names)
    rows = redaction.run_stages(rows, {_BOTH: _BOTH}, [stage])
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.inline_outer(_BOTH))
    return rows.filter(F.col("start").isNotNull())


def redacted(
    df: DataFrame,
    column: str,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    out: str | None = None,
) -> DataFrame:
    """Add ``<column>_redacted``: the raw text with the token of each finding in its place, and nothing
    else changed: no cleaning, no squeezed blanks, no second look, no signature cut. Null stays null."""
    out = out or f"{column}_redacted"
    start, end = traced_span_sql("c.start", "c.end")
    spans = f"transform(s.d, c -> named_struct('s', {start}, 'e', {end}, 'tok', c.replacement))"
    # two findings may share a raw character (one that became several); the later one then starts behind it
    apart = "transform(s.k, (c, i) -> named_struct('s', IF(i = 0, c.s, greatest(c.s, s.k[i - 1].e)), 'e', c.e, 'tok', c.tok))"
    stages = [f"named_struct('x', s.x, 'k', {spans})", f"named_struct('x', s.x, 'k', {apart})", S.splice("s.x", "s.k", "c.tok")]
    rows = _carried(df, column, config, names)
    rows = redaction.run_stages(rows, {_BOTH: _BOTH}, stages)
    return rows.withColumn(out, F.coalesce(F.col(_BOTH), F.col(f"`{column}`"))).drop(_ALIGNED, _FOUND, _BOTH)
