"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts (ties by id, so a group of copies spreads
over as many partitions as it fills), each partition is sorted on disk, and one pass compares each
text with its neighbour in full. Only the first and last text of each partition cross a border,
and a group that spans partitions is joined from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.common import free_name, shared_folder, shuffle_partitions, stored, text_of

#: Characters of a text that a splitter holds.
START = 32


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def compared(sorted_rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Neighbour comparison of rows sorted within partitions.

    Adds part, run (0-based within the partition), row (0-based within the run) and edge: the key
    itself on the first and last row of a partition, else null. `key` itself is left out.
    """
    schema = T.StructType([
        *(sorted_rows.schema[c] for c in carried), T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()),
        T.StructField("row", T.LongType()), T.StructField("first_edge", T.StringType()), T.StructField("last_edge", T.StringType()),
    ])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        run, row, last, held = -1, 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(len(carried))
            new = np.ones(n, dtype=bool)
            if n > 1:
                new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = keys[0].as_py()
            at_start = last is None
            new[0] = at_start or first != last
            runs = run + np.cumsum(new)
            starts = np.where(new, np.arange(n), -1)
            latest = np.maximum.accumulate(starts)
            rows = np.where(latest >= 0, np.arange(n) - latest, row + 1 + np.arange(n))
            if held is not None:
                yield held
            edges = [first if at_start else None, *[None] * (n - 1)]
            last, run, row = keys[n - 1].as_py(), int(runs[-1]), int(rows[-1])
            held = pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carried)], pa.array(np.full(n, part, dtype=np.int32)), pa.array(runs), pa.array(rows), pa.array(edges, pa.string()), pa.nulls(n, pa.string())],
                names=schema.names,
            )
        if held is not None:  # the last batch carries the last text
            ends = pa.array([*[None] * (held.num_rows - 1), last], pa.string())
            yield held.set_column(len(schema.names) - 1, "last_edge", ends)

    return sorted_rows.select(*carried, key).mapInArrow(compare, schema)


def _joined_runs(rows: DataFrame) -> DataFrame:
    """(part, run) -> first part and run of the same text. Two rows per partition enter."""
    borders = rows.where("first_edge is not null or last_edge is not null")
    borders = borders.groupBy("part").agg(
        F.max("first_edge").alias("first_text"), F.max("last_edge").alias("last_text"),
        F.min("run").alias("first_run"), F.max("run").alias("last_run"),
    )
    # one row per partition, a bound set by the number of partitions, not by the input
    along = Window.orderBy("part")
    borders = borders.withColumn("goes_on", F.coalesce(F.lag("last_text").over(along) == F.col("first_text"), F.lit(False)))
    # a partition's first run starts anew unless it goes on; its last run belongs to a chain that
    # began in the nearest partition at or before it whose first run is not the whole partition
    begins = F.when(~F.col("goes_on") | (F.col("first_run") != F.col("last_run")), F.struct("part", F.col("last_run").alias("run")))
    chain = F.last(begins, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    borders = borders.withColumn("chain", chain).withColumn("root", F.lag("chain").over(along))
    return borders.where("goes_on").select("part", F.col("first_run").alias("run"), F.col("root.part").alias("root_part"), F.col("root.run").alias("root_run"))


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the `keep` columns (all but the text by default), keep_id, group_size,
    kept and text_sha256. The new names get a `_` where a kept column has them already.

    Of equal normalised texts the smallest id stays; null ids come last, and where one id and text
    are given twice one of the rows stays.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    # names of our own for all columns on the way, so that none can clash
    inner = {c: f"column_{i}" for i, c in enumerate(keep)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()), F.col(f"`{id_column}`").alias("own_id"), normalised(text_of(text)).alias("normal_text"))
    rows = rows.select("*", F.left("normal_text", F.lit(START)).alias("text_start"), F.sha2(F.encode("normal_text", "utf-8"), 256).alias("sha"), F.col("own_id").isNull().alias("null_id"))
    # splitters are short whatever the texts are: the first characters, then the digest
    order = ["text_start", "sha"]
    parts = shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(parts, *order, "null_id", "own_id").sortWithinPartitions(*order, "normal_text", "null_id", "own_id")
    marked = stored(compared(ordered, "normal_text", [*inner.values(), "own_id", "sha"]), f"{shared_folder(docs.sparkSession)}/compared")
    joins = _joined_runs(marked)
    sizes = marked.groupBy("part", "run").agg(F.min_by("own_id", "row").alias("first_id"), F.count("*").alias("n"))
    sizes = sizes.join(F.broadcast(joins), ["part", "run"], "left")  # one row per partition at most
    sizes = sizes.select("part", "run", "first_id", "n", F.coalesce("root_part", "part").alias("root_part"), F.coalesce("root_run", "run").alias("root_run"))
    # runs that cross borders: as many rows as partitions, so a second small aggregate; the rest is itself
    whole = sizes.groupBy("root_part", "root_run").agg(F.min_by("first_id", "part").alias("keep_id"), F.sum("n").alias("group_size"))
    sizes = sizes.join(whole, ["root_part", "root_run"]).select("part", "run", "keep_id", "group_size", (F.col("part") == F.col("root_part")).alias("opens"))
    named = {c: free_name(docs.select(*(F.col(f"`{k}`") for k in keep)), c) for c in ("keep_id", "group_size", "kept", "text_sha256")}
    found = marked.join(sizes, ["part", "run"])
    return found.select(
        *(F.col(n).alias(c) for c, n in inner.items()), F.col("keep_id").alias(named["keep_id"]), F.col("group_size").alias(named["group_size"]),
        (F.col("opens") & (F.col("row") == 0)).alias(named["kept"]), F.col("sha").alias(named["text_sha256"]),
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, as they came in: whole text, all columns."""
    mark = free_name(docs, "whole_text")
    rows = docs.withColumn(mark, F.col(f"`{text}`"))
    found = groups(rows, id_column, text, keep=[*(c for c in docs.columns if c != text), mark])
    return found.where(found[found.columns[-2]]).select(*(F.col(mark if c == text else f"`{c}`").alias(c) for c in docs.columns))
