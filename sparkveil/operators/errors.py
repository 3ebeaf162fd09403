"""What happens to values that cannot be worked on: an error table beside the rows.

A value with an error is never passed on unredacted: its cleaned column is null, the rest of its row
comes out as usual, and the error table tells column, reason and time. Bad values never reach a
pattern. Everything stays native: checks are columns, the counts are observed while the rows are
written, so that ``max_errors`` needs no second pass over the input.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.operators.redaction import redact_columns, valid_columns
from sparkveil.operators.staging import drop_folder, shared_folder, stored
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.words import NameLists

#: A check takes a text column and gives the reason why it cannot be worked on, or null.
Check = Callable[[Column], Column]

ERRORS = "row_errors"
_ERROR = T.ArrayType(
    T.StructType(
        [T.StructField("column", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("original", T.StringType())]
    )
)


class RowErrors(RuntimeError):
    """The run met more errors than its settings allow; nothing was published."""


@dataclass(frozen=True)
class Outcome:
    rows: int
    errors: int


def undecodable(text: Column) -> Column:
    """Bytes that are no UTF-8 would be matched and cut at random."""
    return F.when(~F.is_valid_utf8(text), F.lit("text is not valid UTF-8"))


def longer_than(size: int) -> Check:
    """For callers who want a limit; there is none by default."""
    return lambda text: F.when(F.octet_length(text) > size, F.lit(f"text has more than {size} bytes"))


def _reason(df: DataFrame, column: str, checks: Sequence[Check], more: Mapping[str, Check]) -> Column:
    text = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, T.StringType):
        text = text.cast("string")
    tests = [*checks, *([more[column]] if column in more else [])]
    return F.coalesce(*(check(text) for check in tests), F.lit(None).cast("string"))


def with_errors(
    df: DataFrame,
    columns: Sequence[str],
    config: RedactionConfig,
    checks: Sequence[Check] = (undecodable,),
    column_checks: Mapping[str, Check] | None = None,
    into: str = ERRORS,
) -> DataFrame:
    """``df`` with its bad values set to null and ``into``: array<struct<column, reason, original>>.

    Errors that ``into`` already holds (from a reader) are kept in front. With
    ``continue_on_error`` off, the first bad value fails the job.
    """
    found, texts = [], {}
    for column in columns:
        reason = _reason(df, column, checks, column_checks or {})
        if not config.continue_on_error:
            told = F.concat(F.lit(f"column {column}: "), reason)
            reason = F.when(reason.isNotNull(), F.raise_error(told).cast("string"))
        shown = F.col(f"`{column}`").cast("string") if config.include_original_in_log else F.lit(None).cast("string")
        found.append(F.when(reason.isNotNull(), F.struct(F.lit(column).alias("column"), reason.alias("reason"), shown.alias("original"))))
        # the reason is tested again, which costs less than carrying it
        texts[column] = F.when(reason.isNull(), F.col(f"`{column}`"))
    errors = F.array_compact(F.array(*found)).cast(_ERROR)
    if into in df.columns:
        errors = F.concat(F.coalesce(F.col(into).cast(_ERROR), F.array().cast(_ERROR)), errors)
    return df.withColumns({**texts, into: errors})


def redact_checked(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    checks: Sequence[Check] = (undecodable,),
    column_checks: Mapping[str, Check] | None = None,
    suffix: str = "_cleaned",
    in_place: bool = False,
) -> DataFrame:
    """``redact_columns`` with ``row_errors`` as last column. One narrow pass; the input columns stay as they are."""
    config = (config or RedactionConfig()).repaired()
    columns = valid_columns(df, columns)
    given = {c: f"__given_{i}" for i, c in enumerate(columns)}
    checked = with_errors(df.withColumns({g: F.col(f"`{c}`") for c, g in given.items()}), columns, config, checks, column_checks)
    done = redact_columns(checked, columns, config, names, suffix)
    if in_place:
        return done.select(*(F.col(f"`{c}{suffix}`" if c in given else f"`{c}`").alias(c) for c in df.columns if c != ERRORS), ERRORS)
    original = [F.col(f"`{given.get(c, c)}`").alias(c) for c in df.columns if c != ERRORS]
    return done.select(*original, *(F.col(f"`{c}{suffix}`") for c in columns), ERRORS)


def good_rows(checked: DataFrame) -> DataFrame:
    """All rows but those that a reader could not make out, which have an error without a column."""
    return checked.where(~F.exists(ERRORS, lambda e: e.column.isNull())).drop(ERRORS)


def error_table(checked: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """One row per error: the ``key`` columns, column, reason, original (null unless asked for) and time."""
    rows = checked.select(*(F.col(f"`{c}`") for c in key), F.explode(ERRORS).alias("e"))
    return rows.select(*(F.col(f"`{c}`") for c in key), "e.column", "e.reason", "e.original", F.current_timestamp().alias("at"))


def error_counts(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors by column and reason, partially aggregated before the shuffle."""
    return error_table(checked, by).groupBy(*by, "column", "reason").agg(F.count("*").alias("n"))


def run(
    df: DataFrame,
    publish: Callable[[DataFrame], None],
    columns: Sequence[str] | None = None,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    key: Sequence[str] = (),
    checks: Sequence[Check] = (undecodable,),
    column_checks: Mapping[str, Check] | None = None,
    suffix: str = "_cleaned",
    in_place: bool = False,
) -> Outcome:
    """Redact, count errors on the way, and publish rows and errors.

    The input is read and worked on once, into a staging table; the number of errors is observed
    meanwhile. At ``max_errors`` or more (0: no limit) RowErrors is raised and nothing is
    published. Else ``publish`` gets the rows and the error table goes to ``error_log_file``
    (Parquet, appended) where the settings name one.
    """
    config = (config or RedactionConfig()).repaired()
    spark = df.sparkSession
    seen = Observation("row errors")
    checked = redact_checked(df, columns, config, names, checks, column_checks, suffix, in_place)
    checked = checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(ERRORS)), F.lit(0)).alias("errors"))
    if not config.error_log_file and config.max_errors <= 0:  # nothing depends on the errors: straight to the output
        publish(good_rows(checked))
        return Outcome(int(seen.get["rows"]), int(seen.get["errors"]))
    folder = shared_folder(spark, "rows")
    try:
        staged = stored(checked, folder)
        outcome = Outcome(int(seen.get["rows"]), int(seen.get["errors"]))
        if config.error_log_file and outcome.errors:
            error_table(staged, key).write.mode("append").parquet(config.error_log_file)
        if 0 < config.max_errors <= outcome.errors:
            raise RowErrors(f"Maximum error threshold reached: {outcome.errors} errors in {outcome.rows} rows")
        publish(good_rows(staged))
    finally:
        drop_folder(spark, folder)
    return outcome
