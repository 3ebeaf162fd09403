"""Readers and writers. Formats are Spark's own; splits, pushdown and commits are its work."""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.functions.sanitize import file_error
from sparkveil.operators import errors
from sparkveil.operators.nested import redact_html, redact_json_text, redact_nested
from sparkveil.operators.redaction import redact_columns, valid_columns
from sparkveil.operators.staging import drop_folder
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.words import NameLists
from sparkveil.sources.records import read_csv

log = logging.getLogger(__name__)

AUDIT_SCHEMA = (
    "timestamp timestamp, action string, client_ip string, user_agent string, client_id string, client_name string, "
    "path string, method string, details map<string,string>, redactions map<string,bigint>, total_redactions bigint"
)

_KIND = {
    ".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".orc": "orc",
    ".html": "html", ".htm": "html", ".xml": "html",
}


def kind_of(path: str) -> str:
    """Format by extension; anything unknown is text."""
    return _KIND.get(os.path.splitext(path.rstrip("/"))[1].lower(), "text")


def read_any(spark: SparkSession, path: str, whole: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    kind = kind_of(path)
    if kind == "text":
        return spark.read.text(path, wholetext=whole)
    if kind == "html":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "html")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        # bad records have a reason in `records.read_csv`, which `process` writes to its error table
        return errors.good_rows(read_csv(spark, path).rows)
    if kind == "json":
        return reader.json(path, multiLine=True)
    return reader.json(path) if kind == "jsonl" else reader.format(kind).load(path)


def text_columns(df: DataFrame) -> list[str]:
    return valid_columns(df, None)


def cleaned_path(path: str) -> str:
    stem, ext = os.path.splitext(path)
    return f"{stem}_cleaned{ext}"


#: Session setting: partitions that a table is dealt into before detection. Unset, nothing is shuffled.
INPUT_PARTITIONS = "spark.sparkveil.inputPartitions"


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """`df` in `parts` partitions; without a number here or in the session, as its files split.

    Detection is heavy on the processor and light on data, so an input of one split may gain from
    being dealt out. Where files have splits enough, `spark.sql.files.maxPartitionBytes` does that
    without a shuffle, so this is left to whoever knows the input.
    """
    parts = parts or int(df.sparkSession.conf.get(INPUT_PARTITIONS, "0"))
    return df.repartition(parts) if parts > 0 and not df.isStreaming else df


#: Rows of one task where each row is short and costs a tenth of a millisecond or more.
ROWS_A_TASK = 25_000


def dealt(df: DataFrame) -> DataFrame:
    """`df` in partitions of about ROWS_A_TASK rows, for tables of many short rows.

    Splits go by bytes, and a few megabytes of keys hold a million rows: minutes of work for one task,
    which grows with the table. Only the columns that are read are shuffled. Counting reads footers
    where the files have them. A number of partitions that the session asks for is left as it is.
    """
    if df.isStreaming or int(df.sparkSession.conf.get(INPUT_PARTITIONS, "0")) > 0:
        return df
    parts = -(-df.count() // ROWS_A_TASK)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def process(
    spark: SparkSession,
    path: str,
    out: str,
    columns: Sequence[str] | None = None,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    in_place: bool = False,
    whole: bool = False,
    parts: int | None = None,
    as_written: bool = False,
    names_file: str | None = None,
) -> DataFrame:
    """Read by extension, redact, write in the same format. Returns what was written.

    CSV, Parquet and ORC get ``<column>_cleaned`` columns; what cannot be worked on goes by the
    error settings of ``config`` (``operators.errors``). JSON with columns named does the same for
    top-level text fields; without, every text leaf is redacted, and ``as_written`` keeps numbers,
    key order and blanks as they are. Text goes line by line unless ``whole``; HTML keeps its
    markup. ``parts`` deals the input out first. Without ``names``, a list in ``names_file`` or in
    one of NAME_PLACES is used beside the built-in one.
    """
    kind = kind_of(path)
    config = config or RedactionConfig()
    names = names or default_names(spark, names_file)
    if kind in ("csv", "parquet", "orc"):
        return _process_columns(spark, path, out, kind, columns, config, names, in_place, parts)
    if kind in ("json", "jsonl") and not columns and as_written:
        rows = spread(spark.read.text(path, wholetext=kind == "json"), parts)
        rows = rows.where("trim(value) <> ''")
        done = redact_json_text(rows, "value", config, names)
        done = done.select(F.when(F.col("value").isNull(), F.raise_error(F.lit(f"{path}: not JSON")).cast("string")).otherwise(F.col("value")).alias("value"))
        write(done, out, "text")
        return done
    df = spread(read_any(spark, path, whole), parts)
    if kind == "html":
        done = redact_html(df, "html", config, names)
    elif kind == "text":
        done = redact_columns(df, ["value"], config, names, in_place=True)
    elif kind in ("json", "jsonl") and not columns:
        done = redact_nested(df, df.columns, config, names)
    elif kind in ("json", "jsonl"):
        texts = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
        done = redact_columns(df, texts, config, names, in_place=in_place) if texts else df
    write(done, out, kind)
    return done


def _process_columns(
    spark: SparkSession,
    path: str,
    out: str,
    kind: str,
    columns: Sequence[str] | None,
    config: RedactionConfig,
    names: NameLists | None,
    in_place: bool,
    parts: int | None,
) -> DataFrame:
    if kind == "csv":
        records = read_csv(spark, path, include_original=config.include_original_in_log)
        if not records.header:
            raise ValueError(f"{path} has no header")
        df, columns = records.rows, columns or records.header
    else:
        df = spark.read.format(kind).load(path)
    outcome = errors.run(spread(df, parts), lambda rows: write(rows, out, kind), columns, config, names, in_place=in_place)
    if kind == "csv":
        drop_folder(spark, records.folder)
    log.info("%s: %d rows, %d errors", path, outcome.rows, outcome.errors)
    return spark.read.csv(out, header=True, quote='"', escape='"', multiLine=True) if kind == "csv" else spark.read.format(kind).load(out)


def write(df: DataFrame, path: str, kind: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif kind in ("json", "jsonl"):
        writer.json(path, ignoreNullFields=False)
    elif kind in ("text", "html"):
        writer.text(path)
    else:
        writer.format(kind).save(path)


# -- name lists --------------------------------------------------------------


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``(name, kind)`` from a txt, csv or json list; kind is first, last or extra."""
    if path.endswith(".json"):
        data = spark.read.json(path, multiLine=True)
        parts = [
            data.select(F.explode(c).alias("name"), F.lit(k).alias("kind"))
            for c, k in (("first_names", "first"), ("last_names", "last"), ("names", "extra"))
            if c in data.columns
        ]
    elif path.endswith(".csv"):
        data = spark.read.csv(path, header=True)
        parts = []
        for c in data.columns:
            low = c.lower()
            if "first" in low or low == "name":
                parts.append(data.select(F.col(f"`{c}`").alias("name"), F.lit("first").alias("kind")))
            elif "last" in low or "surname" in low:
                parts.append(data.select(F.col(f"`{c}`").alias("name"), F.lit("last").alias("kind")))
    else:
        parts = [spark.read.text(path).select(F.col("value").alias("name"), F.lit("extra").alias("kind"))]
    if not parts:
        return spark.createDataFrame([], "name string, kind string")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    clean = out.select(F.lower(F.trim("name")).alias("name"), "kind")
    return clean.filter("name != '' AND NOT startswith(name, '#')").distinct()


MAX_PLAN_NAMES = 100_000


def name_lists(names: DataFrame, base: NameLists | None = None) -> NameLists:
    """Put a names table into a plan; refuses tables over the fixed bound of 100 000 words.

    Larger tables go through ``operators.relational.dictionary_findings``, which joins them.
    """
    rows = names.limit(MAX_PLAN_NAMES + 1).collect()
    if len(rows) > MAX_PLAN_NAMES:
        raise ValueError("too many names for a plan; join the table with dictionary_findings")
    lists = base or NameLists()
    for kind in ("first", "last", "extra"):
        lists = lists.with_names((r["name"] for r in rows if r["kind"] == kind), kind)
    return lists


#: Where a name list is looked for when none is named, in order (fixed values).
NAME_PLACES = ("names.txt", "data/names.txt")


def find_names_file(spark: SparkSession, places: Sequence[str] = NAME_PLACES) -> str | None:
    """The first of these places that holds a file, through Spark's file systems."""
    hadoop = spark._jsc.hadoopConfiguration()
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(hadoop).exists(path):
            return place
    return None


def default_names(spark: SparkSession, names_file: str | None = None) -> NameLists | None:
    """The lists of a run: the built-in ones and a file's, which is named or lies in a default place."""
    path = names_file or find_names_file(spark)
    return name_lists(read_names(spark, path)) if path else None


# -- logs and binaries -------------------------------------------------------


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def triage_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, error)`` of binary files."""
    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", "length", file_error(name, F.col("length"), F.col("content")).alias("error"))
