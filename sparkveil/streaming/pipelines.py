"""Structured Streaming: the same stages over a stream, and windowed metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkveil.functions.mask import mask_log
from sparkveil.operators import errors
from sparkveil.operators.audit import LATENCY_BOUNDS
from sparkveil.operators.redaction import redact_columns
from sparkveil.operators.staging import drop_folder, shared_folder, stored
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.words import NameLists


def checkpoint_dir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A folder for a query under the shared folder the cluster names.

    ``fallback`` is used only where the setting is absent, as on one machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{shared.rstrip('/')}/{name}"


def redact_stream(
    stream: DataFrame,
    columns: Sequence[str],
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
) -> DataFrame:
    """Stateless and narrow: every stage of the batch job, unchanged."""
    return redact_columns(stream, columns, config, names)


def append(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Run what is there and stop; each row is written exactly once."""
    return (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_checked(
    stream: DataFrame,
    columns: Sequence[str],
    path: str,
    errors_path: str,
    checkpoint: str,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    key: Sequence[str] = (),
) -> StreamingQuery:
    """Redact what is there into ``path``, errors into ``errors_path``, and stop.

    Each batch is worked on once, into a staging table, and written to a folder of its own number in
    both places. A batch that is run again after a stop overwrites what it had written, so every
    row and error is there once. Read both with ``read_batches``.
    """
    config = config or RedactionConfig()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = shared_folder(spark, "batch")
        try:
            staged = stored(errors.redact_checked(batch, columns, config, names), folder)
            found = errors.error_table(staged, key)
            n = found.count() if config.max_errors > 0 else 0
            found.write.mode("overwrite").parquet(f"{errors_path}/batch={number}")
            if 0 < config.max_errors <= n:
                raise errors.RowErrors(f"Maximum error threshold reached: {n} errors in batch {number}")
            errors.good_rows(staged).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            drop_folder(spark, folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches that ``append_checked`` has written."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def mask_stream(stream: DataFrame, column: str) -> DataFrame:
    return stream.withColumn(column, mask_log(column))


def windowed_metrics(
    stream: DataFrame,
    ts: str,
    by: Sequence[str],
    value: str,
    failed: Column,
    size: str = "1 hour",
    slide: str | None = None,
    late: str = "10 minutes",
) -> DataFrame:
    """Requests, sum, errors and cumulative value buckets per window and label.

    State is one row per window and label; the watermark bounds how many windows stay open.
    Buckets are conditional counts, so rows are not multiplied.
    """
    naive = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    if naive:  # watermarks need an instant; the session time zone is used both ways
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    buckets = [F.count_if(F.col(value) <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = marked.groupBy(window.alias("w"), *by).agg(
        F.count("*").alias("requests"),
        F.sum(value).alias("total"),
        F.count_if(failed).alias("errors"),
        *buckets,
    )
    kind = "timestamp_ntz" if naive else "timestamp"
    edges = [F.col(f"w.{side}").cast(kind).alias(f"window_{side}") for side in ("start", "end")]
    return out.select(*edges, *[c for c in out.columns if c != "w"])
