"""Small helpers shared by the operators: tables, the shared folder, hashed samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unsigned 64-bit hashes are compared in their upper 31 bits by `sampled`.
_SPAN = 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (`spark.checkpoint.dir`).

    Where the setting is missing, a local master gets a temporary folder; a cluster is refused.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        top = f"file://{tempfile.mkdtemp(prefix='sparkveil-')}"
        context.setCheckpointDir(top)
    return f"{str(top).rstrip('/')}/sparkveil-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(key: Column, rows: int, bound: int) -> Column:
    """True for about `bound` of `rows` rows, chosen by hash, so the same rows on every run."""
    if rows <= bound:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(key), 33) < int(_SPAN * bound / rows)


def text_of(column: str = "text") -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: `join_counted` deals keys that hold more than one of so many rows over several parts.
SHARE = 1000


def join_counted(rows: DataFrame, side: DataFrame, key: str, spot: str) -> DataFrame:
    """`rows` left-joined to `side`, which has each key once; keys are not null.

    Keys that hold more than a 1000th of all rows are at most 1000, so their list is small at any
    size and is broadcast. Each is dealt over as many parts as it holds thousandths, by the number in
    `spot`, and its one row of `side` is given to each part. `rows` is read twice.
    """
    parts = F.ceil(F.col("n") * SHARE / F.lit(max(1, rows.count()))).cast("int")
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("parts", parts).where("parts > 1").select(key, "parts")
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.col(spot), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = side.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [key, "part"], "left").drop("part")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have yet (case ignored)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def held(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with these columns computed once.

    The optimizer may write an expression again wherever it is used, also inside a lambda, where it
    would run per element; it does not do so across a generator.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller pieces, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
