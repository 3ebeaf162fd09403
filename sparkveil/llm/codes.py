"""Vector code compression: one codebook for each part of the vectors, by Lloyd's rounds over cover trees.

Vectors become integers (floor of `scale` times each component) and are cut into equal parts. Each
task lays its rows out in blocks, one cover tree per part, written once; every round walks the
trees with the current codebooks and sends back one count and one sum per entry and task. Only
codebooks (parts x entries vectors) pass the driver. All arithmetic is in integers, so the result
does not depend on how rows are dealt out.

Defined results: vectors that are null or hold null or non-finite components are left out; the
others must have one length, a multiple of `parts`, and components below 2**26 / scale in size, else
a ValueError says which rule fails. Null ids come after all others; rows with one id are in order of
their vectors. Fewer rows than entries make a smaller codebook; no rows make none, and an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.common import shared_folder, stored
from sparkveil.llm.covertree import CoverTree

#: Rows of a block, whose trees one task holds at a time.
BLOCK = 4096
#: Components are smaller than this in size, so that sums and squares stay exact.
MOST = 1 << 26

_TREE = "first", "last", "child", "children", "centre", "order"


@dataclass(frozen=True)
class Layout:
    dims: int
    parts: int
    scale: int

    @property
    def width(self) -> int:
        return self.dims // self.parts


def integers(vectors: DataFrame, id_column: str, vector: str, extra: str | None, scale: int, parts: int) -> tuple[DataFrame, Layout]:
    """(id, extra, v array<long>) of the rows that take part, and how they are laid out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & finite)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    size = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")) * scale))
    found = rows.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.max(size).alias("most")).first()
    low, high = found["low"] or 0, found["high"] or 0
    if low != high or high % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {low} to {high}")
    if (found["most"] or 0) >= MOST - 1:
        raise ValueError(f"components must be below {MOST} / {scale} in size")
    extra_ = F.col(extra).cast("string") if extra else F.lit(None).cast("string")
    return rows.select(F.col(id_column).cast("long").alias("id"), extra_.alias("extra"), whole.alias("v")), Layout(high, parts, scale)


def _first_entries(rows: DataFrame, layout: Layout, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids (nulls last, ties by vector), as first codebooks."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    table = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), layout.dims)
    return list(np.split(table, layout.parts, axis=1))


_BLOCKS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("extras", T.ArrayType(T.StringType())),
        T.StructField("points", T.BinaryType()),
        T.StructField("trees", T.ArrayType(T.StructType([T.StructField(name, T.BinaryType()) for name in (*_TREE, "radius", "total")]))),
    ]
)

_ARROW = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("extras", pa.list_(pa.string())),
        ("points", pa.binary()),
        ("trees", pa.list_(pa.struct([(name, pa.binary()) for name in (*_TREE, "radius", "total")]))),
    ]
)


def blocks(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row per block: its ids, points and the cover tree of each part."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        waiting = 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks()
            points = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, layout.dims)
            trees = []
            for part in np.split(points, layout.parts, axis=1):
                tree = CoverTree.build(np.ascontiguousarray(part))
                packed = {name: getattr(tree, name).astype("<i4").tobytes() for name in _TREE}
                trees.append(packed | {"radius": tree.radius.astype("<f8").tobytes(), "total": tree.total.astype("<i8").tobytes()})
            row = {"ids": table.column("id").to_pylist(), "extras": table.column("extra").to_pylist(), "points": points.astype("<i4").tobytes(), "trees": trees}
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                kept.append(piece)
                waiting += piece.num_rows
                if waiting >= BLOCK:
                    yield block()
                    kept, waiting = [], 0
        if waiting:
            yield block()

    return rows.mapInArrow(lay, _BLOCKS)


def _trees(batch: pa.RecordBatch, layout: Layout) -> Iterator[tuple[pa.StructScalar, np.ndarray, list[CoverTree]]]:
    """Each block of a batch: its row, its points and its trees."""
    points, trees = batch.column("points"), batch.column("trees")
    for k in range(batch.num_rows):
        block = np.frombuffer(points[k].as_buffer(), "<i4").reshape(-1, layout.dims).astype(np.int64)
        built = []
        for part, packed in zip(np.split(block, layout.parts, axis=1), trees[k], strict=True):
            of = {name: np.frombuffer(packed[name].as_buffer(), "<i4").astype(np.int64) for name in _TREE}
            total = np.frombuffer(packed["total"].as_buffer(), "<i8").reshape(-1, layout.width)
            built.append(CoverTree(points=np.ascontiguousarray(part), radius=np.frombuffer(packed["radius"].as_buffer(), "<f8"), total=total, **of))
        yield k, block, built


def one_round(laid: DataFrame, layout: Layout, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after every part has gone to its nearest entry; an entry without parts stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
        totals = [np.zeros(c.shape, dtype=np.int64) for c in codebooks]
        for batch in batches:
            for _, _, trees in _trees(batch, layout):
                for part, tree in enumerate(trees):
                    n, total = tree.sums(codebooks[part])
                    counts[part] += n
                    totals[part] += total
        used = [(p, e) for p, n in enumerate(counts) for e in np.flatnonzero(n)]
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([int(e) for _, e in used], pa.int32()),
             "n": pa.array([int(counts[p][e]) for p, e in used], pa.int64()), "total": pa.array([totals[p][e].tolist() for p, e in used], pa.list_(pa.int64()))}
        )

    sums = laid.mapInArrow(add, "part int, entry int, n long, total array<long>")
    # one row per part and entry reaches the driver
    found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(layout.width))).collect()
    fresh = [c.copy() for c in codebooks]
    for r in found:
        fresh[r["part"]][r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(layout.width)]
    return fresh


def coded(laid: DataFrame, layout: Layout, codebooks: list[np.ndarray]) -> DataFrame:
    """(id, extra, code array<int>, error): nearest entries and the squared distances to them, summed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block, trees in _trees(batch, layout):
                codes = np.stack([tree.codes(book) for tree, book in zip(trees, codebooks, strict=True)], axis=1)
                near = np.concatenate([book[codes[:, p]] for p, book in enumerate(codebooks)], axis=1)
                error = ((block - near) ** 2).sum(axis=1)
                ends = pa.array(np.arange(0, codes.size + 1, layout.parts, dtype=np.int32))
                code = pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("extras")[k].values, code, pa.array(error)], names=["id", "extra", "code", "error"])

    return laid.mapInArrow(add, "id long, extra string, code array<int>, error long")


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", extra: str | None = None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, extra, code, error) of every vector that takes part, and the codebook of each part.

    `extra` names a column that is carried along as text.
    """
    spark: SparkSession = vectors.sparkSession
    folder = shared_folder(spark)
    rows, layout = integers(vectors, id_column, vector, extra, scale, parts)
    if not layout.dims:
        schema = "id long, extra string, code array<int>, error long"
        return spark.createDataFrame([], schema), [np.zeros((0, 0), np.int64)] * parts
    codebooks = _first_entries(rows, layout, entries)
    laid = stored(blocks(rows, layout), f"{folder}/blocks")
    for _ in range(rounds):
        codebooks = one_round(laid, layout, codebooks)
    return coded(laid, layout, codebooks), codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()
