"""Counts, reports and metrics over findings. Partial aggregation first, then one small shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.words import NameLists
from sparkveil.operators.errors import ERRORS
from sparkveil.operators.redaction import with_findings

#: Stands for an error among the counted types.
_FAILED = "\0error"

# Upper bounds of the latency (seconds) and batch-size buckets.
LATENCY_BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
BATCH_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def tokens_in(column: Column | str, strict: bool = False) -> Column:
    """Token names standing in a redacted text. ``strict`` leaves out names with digits."""
    pattern = r"\[([A-Z_]+)\]" if strict else r"\[([A-Z][A-Z0-9_]*)\]"
    return F.regexp_extract_all(F.col(column) if isinstance(column, str) else column, F.lit(pattern), F.lit(1))


def token_counts(df: DataFrame, column: str, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    rows = df.select(*by, F.explode_outer(tokens_in(column, strict)).alias("token")).filter("token IS NOT NULL")
    return rows.groupBy(*by, "token").agg(F.count("*").alias("n"))


def count_by(found: DataFrame, *columns: str) -> DataFrame:
    return found.groupBy(*columns).agg(F.count("*").alias("n"))


def rollup(found: DataFrame, *columns: str) -> DataFrame:
    return found.rollup(*columns).agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, by: Sequence[str] = (), kind: str = "pi_type", n: str = "n") -> DataFrame:
    """The type with the highest count; ties go to the first in alphabetical order."""
    first = F.min_by(F.col(kind), F.struct(-F.col(n), F.col(kind))).alias("most_common")
    return counts.groupBy(*by).agg(first)


def report(
    df: DataFrame,
    column: str | Sequence[str],
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    seconds: float | None = None,
    input_name: str = "",
    output_name: str = "",
) -> DataFrame:
    """One row: rows, counts by type as a map, totals, distinct types, the most common one, errors.

    One pass over one or more columns. Rows are pre-aggregated by type before the shuffle, so only
    a few dozen numbers per task travel, however skewed the types are. Errors are those in a
    ``row_errors`` column, as ``errors.redact_checked`` and the CSV reader give it.
    """
    columns = [column] if isinstance(column, str) else list(column)
    failed = ERRORS in df.columns
    rows = df.select(*(F.col(f"`{c}`") for c in columns), *([ERRORS] if failed else []))
    for i, name in enumerate(columns):
        rows = with_findings(rows, name, config, names, f"__f{i}")
    none = F.array().cast("array<string>")
    kinds = [F.coalesce(F.transform(f"__f{i}", lambda f: f.pi_type), none) for i in range(len(columns))]
    if failed:
        kinds.append(F.transform(ERRORS, lambda _: F.lit(_FAILED)))
    # one empty kind stands for the row itself
    counts = rows.select(F.explode(F.concat(F.array(F.lit("")), *kinds)).alias("pi_type")).groupBy("pi_type").agg(F.count("*").alias("n"))
    row, error = F.col("pi_type") == "", F.col("pi_type") == _FAILED
    found = ~row & ~error
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    out = counts.agg(
        total(row).alias("total_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(found, F.struct(F.col("pi_type"), F.col("n")))))).alias("redactions"),
        total(found).alias("total_redactions"),
        F.count_if(found).alias("redaction_types"),
        F.min_by(F.when(found, F.col("pi_type")), F.when(found, F.struct(-F.col("n"), F.col("pi_type")))).alias("most_common"),
        total(error).alias("error_count"),
    )
    out = out.withColumns(
        {
            "generated_at": F.current_timestamp(),
            "input_file": F.lit(input_name),
            "output_file": F.lit(output_name),
            "columns_processed": F.array(*map(F.lit, columns)),
        }
    )
    if seconds is not None:
        out = out.withColumns(
            {
                "processing_time_seconds": F.round(F.lit(float(seconds)), 2),
                "rows_per_second": F.round(F.col("total_rows") / F.lit(max(float(seconds), 0.001)), 0),
            }
        )
    return out


def write_report(report_row: DataFrame, path: str) -> None:
    report_row.coalesce(1).write.mode("overwrite").json(path)


def row_totals(df: DataFrame, error: str, max_errors: int = 0) -> DataFrame:
    """Rows and failed rows; with a limit the query fails once the count reaches it."""
    out = df.agg(F.count("*").alias("total_rows"), F.count_if(F.col(error).isNotNull()).alias("error_count"))
    if max_errors > 0:
        stop = F.raise_error(F.lit("Maximum error threshold reached."))
        out = out.withColumn("error_count", F.when(F.col("error_count") >= max_errors, stop).otherwise(F.col("error_count")))
    return out


def request_metrics(log: DataFrame, by: Sequence[str], millis: str, failed: Column) -> DataFrame:
    """Requests, total and mean time, errors."""
    return log.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.sum(millis).alias("total_ms"),
        F.avg(millis).alias("mean_ms"),
        F.count_if(failed).alias("errors"),
    )


def labelled_sum(df: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).alias("total"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets: how many values are at most ``le``; the last bucket is endless.

    One conditional count per bound in a single aggregate; rows are never multiplied.
    """
    counts = [F.count_if(F.col(value) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*counts, F.count(value).alias("b_all"))
    buckets = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("b_all").alias("n")))
    return wide.select(*by, F.inline(F.array(*buckets)))


def batch_totals(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("batch_size"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("chars"))


def top_groups(counts: DataFrame, k: int, n: str = "n", tie: str = "pi_type") -> DataFrame:
    """The k largest counts; Spark keeps k rows per task and merges them."""
    return counts.orderBy(F.desc(n), tie).limit(k)
