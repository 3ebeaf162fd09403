"""Chat formatting: reply trees become conversations.

Root-to-leaf paths come from iterative self-joins that double their reach each round, branches are
ranked by score, and each chosen path is written as one text with a mask of the text to learn.
Only ids move in the rounds; each text is joined once, after the paths are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.common import shared_folder, slices, stored

#: Marks of the template; `\\` starts an escape, so no mark can stand inside a text.
TURN, END = "### ", "</turn>\n"
#: (control string, its escape) in the order of escaping; reading back goes the other way.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), (":", "\\c"))

#: Parts in which the leaves of one tree are ranked before their best are ranked together.
RANK_PARTS = 64


def escaped(text: Column, role: bool = False) -> Column:
    """Control strings inside a text, made harmless; a colon matters in role names only."""
    for mark, escape in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(mark), F.lit(escape))
    return text


def unescaped(text: str) -> str:
    for mark, escape in reversed(ESCAPES):
        text = text.replace(escape, mark)
    return text


def paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path: (tree, leaf, node, up), `up` steps above the leaf.

    `messages`: tree, node, parent (null at a root), all free of other nulls. After round k each
    leaf knows its ancestors up to 2**k - 1 steps, so a tree of depth d takes log2(d) + 1 rounds.
    A message whose parent is missing starts a tree of its own; messages on a cycle have no leaf.
    """
    spark = messages.sparkSession
    folder = shared_folder(spark)
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jumps = stored(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("to")), f"{folder}/jump0")
    inner = jumps.select("tree", F.col("to").alias("node")).distinct()
    reach = nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step, round_ = 1, 0
    limit = max(1, messages.count()).bit_length() + 1  # only a cycle would go on
    while round_ < limit and not jumps.isEmpty():
        further = reach.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        reach = stored(reach.unionByName(further), f"{folder}/reach{round_}")
        second = jumps.select("tree", F.col("node").alias("to"), F.col("to").alias("far"))
        jumps = stored(jumps.join(second, ["tree", "to"]).select("tree", "node", F.col("far").alias("to")), f"{folder}/jump{round_ + 1}")
        step, round_ = step * 2, round_ + 1
    return reach


def conversations(messages: DataFrame, branches: int | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: tree, leaf, score, rank, n_turns, text, mask.

    `messages`: tree string, node long, parent long, role string, text string, score double. Null
    roles and texts are empty, null scores 0; a message given twice counts once (smallest role and
    text). Paths of a tree are ranked by the sum of their scores, ties to the smaller leaf;
    `branches` keeps that many per tree, None all. `mask` lists (start, length) in code points of
    the output for each text of a role in `learn`.
    """
    clean = messages.select(
        F.coalesce(F.col("tree").cast("string"), F.lit("\0null")).alias("tree"), F.col("node"), F.col("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).where("node is not null")
    clean = clean.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "node", "m.*")
    reach = paths(clean)
    if branches is not None:
        scored = reach.join(clean.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
        ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("path_score"), "leaf"))
        # a tree of very many leaves is ranked in parts first, of which only the best can be the best
        parts = scored.withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(RANK_PARTS)))
        parts = parts.withColumn("rank", ranked("tree", "part")).where(F.col("rank") <= branches)
        best = parts.withColumn("rank", ranked("tree")).where(F.col("rank") <= branches)
        reach = reach.join(best.select("tree", "leaf", "rank"), ["tree", "leaf"])
    else:
        reach = reach.withColumn("rank", F.lit(None).cast("int"))
    turns = reach.join(clean, ["tree", "node"])
    head = F.concat(F.lit(TURN), escaped(F.col("role"), role=True), F.lit(": "))
    body = escaped(F.col("text"))
    turn = F.struct(
        (-F.col("up")).alias("at"), F.concat(head, body, F.lit(END)).alias("line"),
        F.length(head).alias("skip"), F.length(body).alias("body"), F.col("role").isin(*learn).alias("learn"),
    )
    rows = turns.groupBy("tree", "leaf").agg(F.max("rank").alias("rank"), F.sum("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    # lengths first, then one running sum, so that a path of n turns takes n steps
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("mask")),
        lambda acc, t: F.struct(
            (acc.pos + F.length(t.line)).alias("pos"),
            F.when(t.learn, F.concat(acc.mask, F.array(F.struct((acc.pos + t.skip).alias("start"), t.body.cast("long").alias("length"))))).otherwise(acc.mask).alias("mask"),
        ),
    )
    return rows.select(
        "tree", "leaf", "score", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t.line), "").alias("text"), starts.mask.alias("mask"),
    )


READ_SCHEMA = T.StructType([
    T.StructField("tree", T.StringType()), T.StructField("leaf", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("learned", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


def read_text(text: str, spans: list[dict]) -> tuple[list[dict], str]:
    """Turns and learned text of one formatted conversation."""
    turns = []
    for line in text.split(END)[:-1]:
        role, _, body = line.removeprefix(TURN).partition(": ")
        turns.append({"role": unescaped(role), "text": unescaped(body)})
    return turns, "".join(unescaped(text[s["start"] : s["start"] + s["length"]]) for s in spans)


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts of each turn and all text under the mask, from the output alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(READ_SCHEMA)
        for batch in slices(batches):
            for row in batch.to_pylist():
                turns, learned = read_text(row["text"], row["mask"])
                yield pa.RecordBatch.from_pylist(
                    [{"tree": row["tree"], "leaf": row["leaf"], "n_turns": len(turns), "turns": turns, "learned": learned, "formatted_chars": len(row["text"])}], schema=schema
                )

    return formatted.select("tree", "leaf", "text", "mask").mapInArrow(read, READ_SCHEMA)
