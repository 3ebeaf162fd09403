"""DataFrame operators: redacted columns, details and findings.

All of them are narrow: one pass over the rows, no shuffle, no Python worker.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.functions.detect import Plan
from sparkveil.functions.sql import apply
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.words import NameLists

log = logging.getLogger(__name__)

DETAILS = (
    "struct<redacted_text:string,redactions:array<struct<original:string,replacement:string,pi_type:string,"
    "start:int,end:int,confidence:double,method:string>>,original_length:int,redacted_count:int>"
)


def run_stages(df: DataFrame, targets: Mapping[str, str], stages: Sequence[str]) -> DataFrame:
    """Run SQL stages over columns: ``targets`` maps a new column to the column it starts from.

    A column of type array<string> is worked on element by element.
    """
    many = {
        new: isinstance(df.schema[old].dataType, T.ArrayType) if old in df.columns else False
        for new, old in targets.items()
    }
    for i, stage in enumerate(stages):
        df = df.withColumns(
            {
                new: _stage(old if i == 0 else new, stage, many[new])
                for new, old in targets.items()
            }
        )
    return df


def _stage(column: str, stage: str, many: bool):
    body = stage if stage.startswith("IF(s IS NOT NULL") else f"IF(s IS NULL, NULL, {stage})"
    if many:
        return F.call_function("transform", F.col(f"`{column}`"), F.expr(f"s -> {body}"))
    return apply(F.col(f"`{column}`"), "s", body)


def valid_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """Existing columns among ``columns``; none given means every text column."""
    if not columns:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    good = [c for c in columns if c in df.columns]
    for missing in (c for c in columns if c not in df.columns):
        log.warning("column %s not found, skipped", missing)
    if not good:
        raise ValueError(f"none of the columns {list(columns)} found; available: {df.columns}")
    return good


def redact_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    suffix: str = "_cleaned",
    in_place: bool = False,
) -> DataFrame:
    """Add ``<column><suffix>`` for each column, or replace the columns in place.

    Null stays null and blank stays as it is. Columns that are not text are cast first.
    """
    plan = Plan((config or RedactionConfig()).repaired(), names)
    columns = valid_columns(df, columns)
    work = {f"__r_{i}": c for i, c in enumerate(columns)}
    original = df.columns
    texts = {f"__t_{i}": _as_text(df, c) for i, c in enumerate(columns)}
    out = run_stages(df.withColumns(texts), {w: f"__t_{i}" for i, w in enumerate(work)}, plan.redacted())
    final = {
        c: F.coalesce(f"__r_{i}", f"__t_{i}") for i, c in enumerate(columns)
    }
    if in_place:
        return out.select(*[final[c].alias(c) if c in final else F.col(f"`{c}`") for c in original])
    return out.select(*[F.col(f"`{c}`") for c in original], *[v.alias(f"{c}{suffix}") for c, v in final.items()])


def _as_text(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    col = F.col(f"`{column}`")
    return col if isinstance(kind, (T.StringType, T.ArrayType)) else col.cast("string")


def with_details(
    df: DataFrame,
    column: str,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    out: str = "details",
) -> DataFrame:
    """Add ``struct<redacted_text, redactions[], original_length, redacted_count>``."""
    plan = Plan((config or RedactionConfig()).repaired(), names)
    done = run_stages(df, {out: column}, plan.detailed())
    blank = F.struct(
        F.coalesce(F.col(column), F.lit("")).alias("redacted_text"),
        F.array().cast("array<struct<original:string,replacement:string,pi_type:string,start:int,end:int,confidence:double,method:string>>").alias("redactions"),
        F.coalesce(F.length(column), F.lit(0)).alias("original_length"),
        F.lit(0).alias("redacted_count"),
    )
    return done.withColumn(out, F.coalesce(F.col(out), blank))


def with_findings(
    df: DataFrame,
    column: str,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    out: str = "findings",
) -> DataFrame:
    """Add the kept findings as an array; the redacted text is not built."""
    plan = Plan((config or RedactionConfig()).repaired(), names)
    return run_stages(df, {out: column}, plan.found())


def findings(
    df: DataFrame,
    column: str,
    keep: Sequence[str] = (),
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
) -> DataFrame:
    """The findings relation: one row per kept finding, with the ``keep`` columns.

    Only the kept columns and the text are carried, so the scan reads nothing else.
    """
    slim = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, column])])
    found = with_findings(slim, column, config, names, out="__f")
    # the outer form keeps Catalyst from inferring a filter that would run detection twice
    rows = found.select(*[F.col(f"`{c}`") for c in keep], F.inline_outer("__f"))
    return rows.filter(F.col("start").isNotNull())


def cleaned(df: DataFrame, column: str, out: str, config: RedactionConfig | None = None) -> DataFrame:
    """Add the cleaned text that findings refer to."""
    done = run_stages(df, {out: column}, Plan(config or RedactionConfig()).cleaned())
    return done.withColumn(out, F.coalesce(F.col(out), F.col(column)))
