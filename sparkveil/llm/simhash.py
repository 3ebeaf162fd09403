"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within `RADIUS` = 3 bits are found by exact lookups in two steps, both of which emit
variants within half the radius and shuffle on the variants.

1. One of four 16-bit bands is masked in turn. Of three differing bits one can always be masked, so
   two remain, and the balls of radius 1 around both fingerprints meet in a variant (4 x 49 keys).
   A variant that exactly two fingerprints share is checked bit by bit and gives a link or nothing.
2. Fingerprints that share a variant with more than one other are crowded. They emit their full
   64-bit balls: radius 1, and for odd parity also radius 2. Fingerprints at distance 3 differ in
   parity, so the ball of radius 1 of the one meets the ball of radius 2 of the other; whatever
   meets is within 3 bits by the triangle inequality. Each variant links its members to the
   smallest fingerprint that has it within radius 1, so a crowd of m takes m links, not m * m.

Equal fingerprints are one node from the start, so thousands of copies cost one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.common import free_name, shared_folder, shuffle_partitions, slices, stored, text_of
from sparkveil.llm.graph import components

RADIUS = 3
BANDS = 4
#: Fingerprints per emitted Arrow batch, and shingles per counted block of one text.
_EMIT, _BLOCK = 1024, 1 << 15


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint over word shingles; 0 for a text without words.

    A-Z are lower-cased, words part at ASCII white space, and a text with fewer words than a shingle
    is one shingle. A bit is set where more than half of the shingle hashes have it.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: both calls are ASCII only
    if not words:
        return 0
    shingles = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)), strict=False)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    """`docs` without its text, plus the fingerprint as a long. Null texts are empty."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(into, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(len(rest)).to_pylist()
            values = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(values)], names=schema.names)

    return docs.select(*rest, text_of(text).alias(text)).mapInArrow(add, schema)


def _masked_balls() -> list[tuple[np.ndarray, np.ndarray]]:
    """Per band: the mask of kept bits and the flips within radius 1."""
    width = 64 // BANDS
    found = []
    for band in range(BANDS):
        gone = ((1 << width) - 1) << (band * width)
        keep = np.uint64(~gone & (2**64 - 1))
        flips = [0, *(1 << b for b in range(64) if not gone >> b & 1)]
        found.append((keep, np.array(flips, dtype=np.uint64)))
    return found


def _full_ball(radius: int) -> np.ndarray:
    ones = [1 << b for b in range(64)]
    flips = [0, *ones] if radius == 1 else [ones[a] | ones[b] for a in range(64) for b in range(a)]
    return np.array(flips, dtype=np.uint64)


def masked_variants(nodes: DataFrame) -> DataFrame:
    """fp -> (band, variant, fp), radius 1 outside of the masked band."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = _masked_balls()
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), _EMIT):
                fps = every[at : at + _EMIT]
                for band, (keep, flips) in enumerate(balls):
                    variants = ((fps & keep)[:, None] ^ flips[None, :]).ravel().view(np.int64)
                    own = np.repeat(fps, len(flips)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), band, dtype=np.int8)), pa.array(variants), pa.array(own)], names=["band", "variant", "fp"])

    return nodes.mapInArrow(emit, "band byte, variant long, fp long")


def full_variants(nodes: DataFrame) -> DataFrame:
    """fp -> (variant, fp, near): radius 1 for all, radius 2 besides for fingerprints of odd parity."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = _full_ball(1), _full_ball(2)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), _EMIT // 4):
                fps = every[at : at + _EMIT // 4]
                odd = fps[np.bitwise_count(fps) % 2 == 1]
                for some, flips in ((fps, near), (odd, far)):
                    variants = (some[:, None] ^ flips[None, :]).ravel().view(np.int64)
                    own = np.repeat(some, len(flips)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(variants), pa.array(own), pa.array(np.full(len(own), flips is near))], names=["variant", "fp", "near"])

    return nodes.mapInArrow(emit, "variant long, fp long, near boolean")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within `RADIUS`; `nodes`: distinct fp."""
    spark = nodes.sparkSession
    folder = shared_folder(spark)
    parts = shuffle_partitions(spark)
    of = Window.partitionBy("band", "variant")
    met = masked_variants(nodes.select("fp").repartition(parts, "fp")).select("fp", F.count("*").over(of).alias("n"), F.min("fp").over(of).alias("a"), F.max("fp").over(of).alias("b"))
    # a pair of two: one of its rows is enough; crowds: each member once
    met = met.where((F.col("n") > 2) | ((F.col("n") == 2) & (F.col("fp") == F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)))
    alone = F.col("n") == 2
    met = stored(met.select(F.when(alone, F.col("a")).alias("a"), F.when(alone, F.col("b")).alias("b"), F.when(~alone, F.col("fp")).alias("fp")).distinct(), f"{folder}/met")
    pairs = met.where("fp is null").select("a", "b")
    crowd = met.where("fp is not null").select("fp").repartition(parts, "fp")
    balls = full_variants(crowd)
    centre = balls.where("near").groupBy("variant").agg(F.min("fp").alias("a"))
    # radius 2 is for distance 3 alone: whatever is closer meets in balls of radius 1 and is linked there
    wanted = F.col("near") | (F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) == RADIUS)
    # the planner cannot know how many variants a row gives, and would broadcast them
    stars = balls.join(centre.hint("merge"), "variant").where((F.col("fp") != F.col("a")) & wanted).select("a", F.col("fp").alias("b")).distinct()
    return stored(pairs.unionByName(stars), f"{folder}/links")


def _classes(marked: DataFrame, folder: str) -> DataFrame:
    """(fp, component_id) of rows (doc_id, fp)."""
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/nodes")
    joined = components(links(nodes))
    classes = nodes.join(joined.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    least = classes.groupBy("c").agg(F.min("first").alias("component_id"))
    return classes.join(least, "c").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of `RADIUS` bits or fewer.

    Null texts are empty; texts without words have fingerprint 0 and link like any other. Repeated
    rows each get a row. A null id counts as no candidate for the smallest; a component of null
    ids only has a null id.
    """
    folder = shared_folder(docs.sparkSession)
    marked = stored(fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), shingle=shingle), f"{folder}/fingerprints")
    return marked.join(_classes(marked, folder), "fp").select(F.col("doc_id").alias(id_column), "fp", "component_id")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component (see `near_duplicates`).

    Rows that share the smallest id of a component stay together; rows with a null id stay. A row
    goes by its id and a digest of its text, so an id given to two texts loses only the one that is
    a copy.
    """
    folder = shared_folder(docs.sparkSession)
    digest = free_name(docs, "digest")
    rows = docs.withColumn(digest, F.xxhash64(text_of(text)))
    marked = rows.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(digest).alias("digest"), F.col(f"`{text}`").alias("text"))
    marked = stored(fingerprints(marked, shingle=shingle), f"{folder}/fingerprints")
    gone = marked.join(_classes(marked.select("doc_id", "fp"), folder), "fp").where("doc_id <> component_id")
    gone = gone.select(F.col("doc_id").alias(id_column), F.col("digest").alias(digest)).distinct()
    return rows.join(gone, [id_column, digest], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
