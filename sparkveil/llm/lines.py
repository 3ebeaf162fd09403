"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the last lines' hashes ends a chunk wherever it is divisible by `DIVISOR`, so
chunk borders follow the content and come back in step after an inserted or lost line. The line at a
border belongs to both its chunks; so two lines in a row always share a chunk. Chunks that occur
again anywhere lose all but their first occurrence. What is left of a repeated passage then lies at
its two ends, inside chunks that only partly agree: the distinct chunks, one of each, are compared
by their pairs of lines. Together: **a line goes if it and the line before or after it stand in a
row at an earlier place**, in this document or another. Every line that goes still stands at the
earliest of its places.

Defined cases: a line takes the blank lines after it along (the first line also those before it),
and a text of blank lines only is one line. A single repeated line between different neighbours
stays. Three or more equal lines in a row become one. Null counts as empty and stays null; rows
given twice are one document; rows of one id with different texts are two. Bytes decide: passages
that differ in a blank or a line break at their end are different there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import free_name, held, join_counted, shared_folder, stored, text_of

#: Lines that the rolling hash looks at, and mean lines from one border to the next.
WINDOW, DIVISOR = 2, 3
#: Multiplier of the rolling hash, which is kept below 2**32.
MULTIPLIER, SPAN = 31, 1 << 32
#: Line breaks before a line that is not blank.
BREAK = r"\n(?=[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D])"
#: A place is a document and a line of it.
PLACE = ("doc_id", "digest", "pos")


def line_hash(line: Column) -> Column:
    """The first 32 bits of the MD5 of a line."""
    return F.conv(F.substring(F.md5(F.encode(line, "utf-8")), 1, 8), 16, 10).cast("long")


def line_key(seed: int):
    """64 bits of a line; two seeds give the 128 bits by which lines are sought."""
    return lambda line: F.xxhash64(F.lit(seed), line)


def lines_of(text: Column) -> Column:
    """The lines of a text, each with the blank lines after it; `text` is not null."""
    parts = F.split(text, BREAK, -1)
    first = F.get(parts, F.lit(0))
    led = (F.size(parts) > 1) & ~F.rlike(first, F.lit(r"[^\x20\x09-\x0D]"))
    joined = F.concat(F.array(F.concat_ws("\n", first, F.get(parts, F.lit(1)))), F.slice(parts, F.lit(3), F.size(parts)))
    return F.when(led, joined).otherwise(parts)


def with_borders(rows: DataFrame) -> DataFrame:
    """`rows` with `ends`, the places in the array `lines` where chunks end; the last line always does."""
    rest = rows.columns
    rows = held(rows.withColumn("hashes", F.transform("lines", line_hash)), "hashes")
    rolled = F.col("hashes")
    for back in range(1, WINDOW):
        before = F.concat(F.array_repeat(F.lit(0).cast("long"), back), F.col("hashes"))
        rolled = F.zip_with(rolled, F.slice(before, F.lit(1), F.size("hashes")), _weighted(MULTIPLIER**back))
    rows = held(rows.select(*rest, F.transform(rolled, lambda r: r % SPAN).alias("rolled")), "rolled")
    ends = F.filter(F.transform("rolled", lambda r, i: F.when((r % DIVISOR == 0) | (i == F.size("lines") - 1), i)), lambda i: i.isNotNull())
    return held(rows.select(*rest, ends.alias("ends")), "ends")


def _weighted(factor: int):
    return lambda a, b: a + b * factor


def chunks(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, n_lines, key, pairs) of every chunk of two or more lines of rows (doc_id,
    digest, text): hashes only. `pairs` holds the key of each line with its next, in order."""
    rest = ["doc_id", "digest"]
    rows = with_borders(held(rows.select(*rest, lines_of(F.col("text")).alias("lines")), "lines").where(F.size("lines") > 1))
    rows = held(rows.select(*rest, "ends", *(F.transform("lines", line_key(s)).alias(f"k{s}") for s in (1, 2))), "k1", "k2")
    after = lambda c: F.slice(c, F.lit(2), F.size(c) - 1)
    before = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    twos = [F.zip_with(before(c), after(c), lambda a, b: F.xxhash64(a, b)).alias(c) for c in ("k1", "k2")]
    rows = held(rows.select(*rest, "ends", F.arrays_zip(*twos).alias("pairs")), "pairs")
    starts = F.slice(F.concat(F.array(F.lit(0)), F.col("ends")), F.lit(1), F.size("ends"))
    rows = held(rows.withColumn("spans", F.arrays_zip(F.col("ends").alias("e"), starts.alias("s"))), "spans")
    rows = rows.select(*rest, "pairs", F.inline("spans")).where("e > s")
    rows = rows.select(*rest, F.col("s").alias("pos"), (F.col("e") - F.col("s") + 1).alias("n_lines"), F.slice("pairs", F.col("s") + 1, F.col("e") - F.col("s")).alias("pairs"))
    return rows.withColumn("key", F.struct(F.xxhash64("pairs.k1").alias("k1"), F.xxhash64("pairs.k2").alias("k2")))


def _met(rows: DataFrame) -> DataFrame:
    """`rows` with `first`, the earliest place of their key, where the key has several rows, else null."""
    firsts = rows.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return join_counted(rows.withColumn("spot", F.xxhash64("digest", "pos")), firsts, "key", "spot").drop("spot")


def _again() -> Column:
    return F.col("first").isNotNull() & ~F.struct(*PLACE).eqNullSafe(F.col("first"))


def _by_document(found: DataFrame) -> DataFrame:
    """One row per document with its (pos, n_lines, key, again), at most two per line."""
    places = F.collect_set(F.struct("pos", "n_lines", "key", "again"))
    return found.groupBy(F.col("doc_id").alias("at_id"), F.col("digest").alias("at_digest")).agg(places.alias("places"))


def _at_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("digest") == F.col("at_digest"))


def repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(at_id, at_digest, gone): by document, which lines stand in a repeated place.

    Chunks and pairs are sought by 128 bits of hashes and then compared by their bytes: all texts of
    a key must be one, which partial minimum and maximum tell without dealing a hot text to one task.
    Should two texts share a key, every pair of lines is compared as text instead.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    every = stored(chunks(rows), f"{folder}/chunks")
    every = stored(_met(every).withColumn("again", _again()), f"{folder}/met")
    pairs = every.where(~F.col("again")).select("doc_id", "digest", F.col("pos").alias("start"), F.posexplode("pairs").alias("i", "key"))
    pairs = _met(pairs.select("doc_id", "digest", (F.col("start") + F.col("i")).alias("pos"), F.lit(2).alias("n_lines"), "key"))
    kept = [*PLACE, "n_lines", "key", "again"]
    found = every.where("first is not null").select(kept).union(pairs.where("first is not null").withColumn("again", _again()).select(kept))
    found = stored(_by_document(found), f"{folder}/found")
    texts = rows.join(found, _at_document()).select(lines_of(F.col("text")).alias("lines"), "places")
    texts = held(texts, "lines").select("lines", F.explode("places").alias("p"))
    texts = texts.select("p.key", "p.n_lines", F.array_join(F.slice("lines", F.col("p.pos") + 1, F.col("p.n_lines")), "\n").alias("text"))
    mixed = texts.groupBy("key", "n_lines").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b")
    if not mixed.isEmpty():
        found = stored(_by_document(_by_text(rows)), f"{folder}/compared")
    gone = F.flatten(F.transform(F.filter("places", lambda p: p.again), lambda p: F.sequence(p.pos, p.pos + p.n_lines - 1)))
    return found.select("at_id", "at_digest", F.array_distinct(gone).alias("gone")).where(F.size("gone") > 0)


def _by_text(rows: DataFrame) -> DataFrame:
    """The repeated places again, with each pair of lines itself as its key."""
    lines = held(rows.select("doc_id", "digest", lines_of(F.col("text")).alias("lines")), "lines").where(F.size("lines") > 1)
    pairs = F.zip_with(F.slice("lines", F.lit(1), F.size("lines") - 1), F.slice("lines", F.lit(2), F.size("lines") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = _met(lines.select("doc_id", "digest", F.posexplode(pairs).alias("pos", "key")))
    return pairs.withColumn("again", _again()).withColumn("n_lines", F.lit(2))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of `docs`; repeated lines are gone from the text, and n_lines, n_chunks
    and removed_lines tell how many there were and went. A text that loses nothing stays as it is
    (null too); one that loses all is empty.
    """
    names = {c: free_name(docs, c) for c in ("n_lines", "n_chunks", "removed_lines")}
    gone = repeats(docs, id_column, text)
    whole = text_of(f"row.`{text}`")
    row = docs.select(F.struct(*docs.columns).alias("row")).withColumn("doc_id", F.col(f"row.`{id_column}`")).withColumn("digest", F.xxhash64(whole))
    rows = row.join(gone, _at_document(), "left")
    rows = held(rows.select("row", F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"), lines_of(whole).alias("lines")), "lines", "gone")
    rows = with_borders(rows)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return rows.select(
        *(F.when(F.size("gone") == 0, F.col(f"row.`{c}`")).otherwise(left).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns),
        F.size("lines").cast("long").alias(names["n_lines"]), F.size("ends").cast("long").alias(names["n_chunks"]), F.size("gone").cast("long").alias(names["removed_lines"]),
    )
