"""CSV files in many tasks, also where quoted values hold line breaks.

Spark's own multi-line reader gives a whole file to one task. Here a file is read by lines in its
splits. What a line does to the state "inside quotes or not" is one of four functions: it leaves the
state as it is, turns it round, or ends outside or inside whatever came before. Such functions
compose, so a running sum over the lines of a split and another over the splits of a file tell where
each record begins. That takes a few bytes a line. The text is written once and, where records span
lines, shuffled once, to the split in which its record begins; otherwise it is parsed where it stands.

Within a record, fields are parted by the delimiter; a field that begins with a quote ends at the
next single quote, and two quotes stand for one. A quote elsewhere is an ordinary character.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.operators.errors import ERRORS
from sparkveil.operators.staging import shared_folder, stored

MANY_FIELDS = "more fields than the header has"
UNFINISHED = "a quoted value does not end before the file does"


@dataclass(frozen=True)
class Records:
    """Rows of all good records, with ``row_errors`` for the bad ones, whose columns are null."""

    rows: DataFrame
    header: list[str]
    folder: str


def _patterns(delimiter: str) -> tuple[str, str, str]:
    """What ends a line inside quotes, what closes the quotes that a line begins in, and one field."""
    d = "\\t" if delimiter == "\t" else "\\" + delimiter
    quoted = '"(?:[^"]|"")*+"'
    field = f"(?:{quoted}[^{d}]*+|(?!\")[^{d}]*+)"
    return f'^(?:{field}{d})*+"(?:[^"]|"")*+$', '^(?:[^"]|"")*+"', f"(?:^|{d}){field}"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, at, line): lines in order within the blocks of each file."""
    source = spark.read.format("text").option("lineSep", "\n").option("encoding", encoding).load(path)
    place = F.col("_metadata")
    return source.select(
        place["file_path"].alias("file"), place["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )


def _effect(line: Column, opened: str, closing: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, if it begins outside and if it begins inside."""
    quote = F.contains(line, F.lit('"'))
    # behind the closing quote the field goes on as an ordinary one
    rest = F.concat(F.lit("x"), F.regexp_replace(line, closing, ""))
    from_inside = F.when(~quote, True).when(line.rlike(closing), rest.rlike(opened)).otherwise(True)
    return F.when(quote, line.rlike(opened)).otherwise(False), from_inside


def _before(rows: DataFrame, parts: list[str], order: list[str], outside: str, inside: str, into: str) -> DataFrame:
    """Adds `into`, the composition of all lines before: struct<fixed, state, turned>.

    A line that ends alike from both states fixes it; one that ends otherwise from both turns it.
    """
    earlier = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    fixes, turns = F.col(outside) == F.col(inside), F.col(outside) & ~F.col(inside)
    turned = F.coalesce(F.sum(turns.cast("long")).over(earlier), F.lit(0))
    rows = rows.withColumns({"__n": turned, "__f": F.when(fixes, F.struct(F.col(outside).alias("state"), turned.alias("n")))})
    last = F.last("__f", ignorenulls=True).over(earlier)
    rows = rows.withColumn("__l", last)
    made = F.struct(
        F.col("__l").isNotNull().alias("fixed"),
        F.coalesce(F.col("__l.state"), F.lit(False)).alias("state"),
        ((F.col("__n") - F.coalesce(F.col("__l.n"), F.lit(0))) % 2 == 1).alias("turned"),
    )
    return rows.withColumn(into, made).drop("__n", "__f", "__l")


def _applied(function: Column, state: Column) -> Column:
    """The state after a composition, from the state before it."""
    start = F.when(function["fixed"], function["state"]).otherwise(state)
    return start != function["turned"]


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", header: list[str] | None = None, include_original: bool = False
) -> Records:
    """Records of one or more CSV files with one header, all columns as text.

    Records with more fields than the header, and the lines of a quoted value that never ends, are
    errors; missing fields are null; empty lines are no records. Clear ``Records.folder`` with
    ``staging.drop_folder`` once the rows are written.
    """
    folder = shared_folder(spark, "csv")
    opened, closing, field = _patterns(delimiter)
    outside, inside = _effect(F.col("line"), opened, closing)
    # written once, so that the numbers of the lines are the same wherever they are used
    lines = stored(_lines(spark, path, encoding).withColumns({"o": outside, "i": inside}), f"{folder}/lines")
    if lines.where("o").isEmpty():
        records = lines.select("file", "block", "at", F.col("line").alias("record"), F.lit(None).cast("string").alias("bad"))
    else:
        records = _joined(lines, stored(_blocks(lines), f"{folder}/blocks"))
    first = (F.col("block") == 0) & (F.col("at") == F.col("start"))
    if header is None:
        # one short row per file says which record is the header; stored, as Spark knows the size of files
        starts = stored(lines.where("block = 0").groupBy("file").agg(F.min("at").alias("start")), f"{folder}/starts")
        records = records.join(starts, "file", "left")
        of = starts.agg(F.min("file")).first()[0]
        # file and split go down to the lines, so that only the first split of one file is worked on
        top = records.where((F.col("file") == of) & (F.col("block") == 0)).where(first).select("record").first()
        if top is None:
            return Records(spark.createDataFrame([], f"{ERRORS} array<struct<column:string,reason:string,original:string>>"), [], folder)
        header = _header(spark, top["record"], delimiter, field)
        records = records.where(~F.coalesce(first, F.lit(False))).drop("start")
    records = records.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> '' OR bad IS NOT NULL")
    return Records(_parsed(records, header, delimiter, field, include_original), header, folder)


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, first, carried, unfinished): one row per split with lines.

    ``first`` is its first line that begins a record, ``carried`` the last split before it with such a
    line, ``unfinished`` where a record begins that the end of the file leaves open.
    """
    inner = _before(lines.select("file", "block", "at", "o", "i"), ["file", "block"], ["at"], "o", "i", "f")
    made = []
    for name, state in (("o", False), ("i", True)):
        before = _applied(F.col("f"), F.lit(state))
        begun = F.when(~before, F.col("at"))
        after = F.when(before, F.col("i")).otherwise(F.col("o"))
        made += [F.max_by(after, "at").alias(name), F.min(begun).alias(f"first_{name}"), F.max(begun).alias(f"last_{name}")]
    blocks = _before(inner.groupBy("file", "block").agg(*made), ["file"], ["block"], "o", "i", "g")
    begins = _applied(F.col("g"), F.lit(False))
    blocks = blocks.select("file", "block", *[F.when(begins, F.col(i)).otherwise(F.col(o)).alias(n) for n, o, i in (("ends", "o", "i"), ("first", "first_o", "first_i"), ("last", "last_o", "last_i"))])
    file = Window.partitionBy("file")
    with_start = F.when(F.col("first").isNotNull(), F.col("block"))
    tail = F.max(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("at")))).over(file)
    return blocks.select(
        "file", "block", "first",
        F.last(with_start, ignorenulls=True).over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.when(F.max(F.struct("block", "ends")).over(file)["ends"], tail).alias("unfinished"),
    )


def _joined(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, block, at, record, bad): lines that make one record brought together under its first line.

    Lines before the first record of a split go to the split that holds the beginning of theirs, so
    that whole records lie in one group, which begins outside quotes. Lines of a record that never
    ends stay in their splits.
    """
    bad = F.coalesce(F.struct("block", "at") >= F.col("unfinished"), F.lit(False))
    head = F.coalesce(F.col("at") < F.col("first"), F.lit(True))
    placed = lines.join(blocks, ["file", "block"]).select(
        "file", F.when(~bad & head, F.col("carried")).otherwise(F.col("block")).alias("home"), "block", "at", "line", "o", "i", bad.alias("lost")
    )
    placed = _before(placed, ["file", "home"], ["block", "at"], "o", "i", "f")
    starts = ~_applied(F.col("f"), F.lit(False)) | F.col("lost")
    within = Window.partitionBy("file", "home").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("file", "home", "block", "at", "line", "lost", F.max(F.when(starts, F.struct("block", "at"))).over(within).alias("of"))
    # the lines lie by file and home already: this moves nothing
    whole = placed.groupBy("file", "home", "of", "lost").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x.line), "\n")
    return whole.select("file", F.col("home").alias("block"), F.col("of.at").alias("at"), text.alias("record"), F.when(F.col("lost"), UNFINISHED).alias("bad"))


def _values(record: Column, delimiter: str, field: str) -> Column:
    """The fields of a record: quotes taken off, doubled quotes made single, unquoted empty ones null."""
    raw = F.regexp_extract_all(record, F.lit(field), F.lit(0))
    plain = F.transform(raw, lambda f, i: F.when(i == 0, f).otherwise(F.substr(f, F.lit(2))))

    def value(f: Column) -> Column:
        inner = F.regexp_extract(f, '(?s)^"((?:[^"]|"")*+)"', 1)
        behind = F.regexp_replace(f, '(?s)^"(?:[^"]|"")*+"', "")
        return F.when(f.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), behind)).when(f != "", f)

    return F.transform(plain, value)


def _header(spark: SparkSession, record: str, delimiter: str, field: str) -> list[str]:
    """Column names; empty ones are numbered, repeated ones get their place behind them."""
    rows = spark.createDataFrame([(record.removeprefix("\ufeff").removesuffix("\r"),)], "r string")
    names = [n if n else f"_c{i}" for i, n in enumerate(rows.select(_values(F.col("r"), delimiter, field)).first()[0])]
    seen: set[str] = set()
    out = []
    for i, name in enumerate(names):
        name = name if name.lower() not in seen else f"{name}_{i}"
        seen.add(name.lower())
        out.append(name)
    return out


def _parsed(records: DataFrame, header: list[str], delimiter: str, field: str, include_original: bool) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("column", "reason", "original")]))
    rows = records.select("record", "bad", _values(F.col("record"), delimiter, field).alias("v"))
    # the outer form of a generator keeps the values from being worked out once per column
    rows = rows.select("record", "bad", F.explode_outer(F.array("v")).alias("v"))
    reason = F.coalesce("bad", F.when(F.size("v") > len(header), F.lit(MANY_FIELDS)))
    rows = rows.withColumn("reason", reason)
    columns = [F.when(F.col("reason").isNull(), F.get("v", F.lit(i))).alias(name) for i, name in enumerate(header)]
    error = F.struct(F.lit(None).cast("string").alias("column"), F.col("reason").alias("reason"), (F.col("record") if include_original else F.lit(None).cast("string")).alias("original"))
    errors = F.when(F.col("reason").isNotNull(), F.array(error)).otherwise(F.array()).cast(kind)
    return rows.select(*columns, errors.alias(ERRORS))
