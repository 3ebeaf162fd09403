"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each with its own codebook; a pair of centroids is a cell. A query
goes through the cells by summed nearness with a heap until enough entries are in view, and those
entries are scored exactly. Cells are joined with their queries in blocks of bounded size, so a
cell with a third of all vectors becomes many blocks of work and none is cut short.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm.common import sampled, shared_folder, shuffle_partitions, stored

#: Vectors that the codebooks are fitted on, at most about this many, chosen by hash.
TRAINING_ROWS = 20_000
#: Mean number of entries of a cell, from which the number of centroids follows, and its bound.
PER_CELL, MOST_CENTROIDS = 16, 2048
#: Share of true neighbours that the visited cells must cover on the sample, with as many queries.
COVERED, SAMPLE_QUERIES = 0.95, 200
#: Entries and queries of a block of work.
BLOCK, SLICE = 8192, 2048


def usable(rows: DataFrame, id_column: str, vector: str, kind: str = "float") -> DataFrame:
    """(id, v): vectors that are not null or zero, have finite components, and the usual length.

    The usual length is the most frequent one, ties to the longer. Null ids are left out. `kind` is
    the type of the components.
    """
    v = F.col(vector).cast(f"array<{kind}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null").where(F.coalesce(fine, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spaced starts over the sorted first component, in the type of the points."""
    k = max(1, min(k, len(points)))
    order = np.random.default_rng(7).permutation(len(points))
    centres = points[order[:k]]
    for _ in range(rounds):
        near = nearest(points, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=points[:, j], minlength=k) for j in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(points.dtype)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)
    norms = (centres.astype(np.float64) ** 2).sum(axis=1)
    for at in range(0, len(points), 4096):
        some = points[at : at + 4096]
        out[at : at + 4096] = (norms - 2 * (some @ centres.T)).argmin(axis=1)
    return out


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in the order of first + second (largest first) until `wanted` entries are in view.

    The heap holds the frontier of centroid pairs; a pair enters once its left or upper neighbour
    has left, so pairs come in order without scoring all of them.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    fa, fb, width = first[a], second[b], len(second)
    heap, entered = [(-(fa[0] + fb[0]), 0, 0)], {(0, 0)}
    cells, seen = [], 0
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if sizes[cell]:
            cells.append(cell)
            seen += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(fa) and y < len(fb) and (x, y) not in entered:
                entered.add((x, y))
                heapq.heappush(heap, (-(fa[x] + fb[y]), x, y))
    return cells


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def needed_share(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int) -> float:
    """Share of all entries, in the order of the cells, that covers `COVERED` of the neighbours.

    Measured on the bounded sample: for each true neighbour of a sample query, the share of entries
    whose cells come before its own. A larger table has nearer neighbours, which come earlier.
    """
    half = books[0].shape[1]
    one, two = nearest(sample[:, :half], books[0]), nearest(sample[:, half:], books[1])
    shares = []
    for at in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
        q = sample[at]
        exact = sample @ q
        exact[at] = -np.inf
        true = np.argsort(-exact)[: min(k, len(sample) - 1)]
        cell = (books[0] @ q[:half])[one] + (books[1] @ q[half:])[two]
        ordered = np.sort(cell)
        shares += list(1 - np.searchsorted(ordered, cell[true], side="left") / len(sample))  # the own cell counts whole
    return float(np.quantile(shares, COVERED)) if shares else 1.0


def best_of(queries: np.ndarray, entries: np.ndarray, seen: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, scores) of the k largest inner products per query among the entries it has seen.

    Scores are double-precision sums from the first component to the last; everything within
    rounding of the k-th is kept, so ties are left to the caller.
    """
    q, e = queries.astype(np.float64), entries.astype(np.float64)
    rough = np.where(seen, q @ e.T, -np.inf)
    out = []
    for row, own in zip(rough, q, strict=True):
        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        least -= 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else 0.0
        places = np.flatnonzero((row >= least) & (row > -np.inf))
        score = np.zeros(len(places))
        for j in range(len(own)):
            score += own[j] * e[places, j]
        out.append((places, score))
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query by largest inner product.

    Both tables have `id_column` and `vector`; an entry with the query's own id never counts. Of
    equal vectors only the k + 1 smallest ids are entered: ties go to the smaller id, so no other
    can be among k results. Equal query vectors are searched once.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    # single-precision components stay so; all others are kept in double
    single = all(t.schema[vector].dataType.simpleString() == "array<float>" for t in (rows, queries))
    kind, dtype = ("float", np.float32) if single else ("double", np.float64)
    fine = stored(usable(rows, id_column, vector, kind), f"{folder}/vectors")
    empty = "query_id long, rank int, id long, score double"
    total = fine.count()
    if not total:
        return spark.createDataFrame([], empty)
    length = fine.select(F.size("v")).first()[0]
    half = length // 2
    # one row per vector; ranks within equal vectors, so the cut is exact
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = fine.distinct().withColumn("r", rank).where(F.col("r") <= k + 1).drop("r")
    sample = np.array([r["v"] for r in fine.where(sampled(F.col("id"), total, TRAINING_ROWS)).select("v").collect()], dtype=dtype)
    if not len(sample):
        sample = np.array([fine.first()["v"]], dtype=dtype)
    size = max(1, min(MOST_CENTROIDS, int(np.sqrt(total / PER_CELL))))
    books = (kmeans(sample[:, :half], size) if half else np.zeros((1, 0), dtype), kmeans(sample[:, half:], size))
    width = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(1))
            cells = nearest(v[:, :half], books[0]) * width + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["id", "v", "cell"])

    placed = stored(entries.mapInArrow(place, f"id long, v array<{kind}>, cell long"), f"{folder}/cells")
    # one count per cell: bounded by the square of the number of centroids
    sizes = np.zeros(len(books[0]) * width, dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    wanted = int(np.ceil(needed_share(sample, books, k) * sizes.sum()))
    # blocks of whole neighbouring cells, about BLOCK entries each; a larger cell is cut by id hash
    block_of = (np.cumsum(sizes) - sizes) // BLOCK
    parts_of = np.maximum(1, -(-sizes // BLOCK))

    asked = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("q"))
    asked = usable(asked, "id", "q", kind).where(F.size("v") == length)
    asked = asked.groupBy("v").agg(F.min("id").alias("query")).select("query", "v")
    asked = stored(asked, f"{folder}/queries")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(1))
            for at, (x, y) in enumerate(zip(v[:, :half] @ books[0].T, v[:, half:] @ books[1].T, strict=True)):
                cells = np.array(sorted(traverse(x, y, sizes, wanted)), dtype=np.int64)
                rows = []
                for block in np.unique(block_of[cells]):
                    own = cells[block_of[cells] == block]
                    # all parts of a block see the same list; a part without these cells has no entry for them
                    rows += [(int(block), part, own.tolist()) for part in range(int(parts_of[own].max()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), batch.column(0)[at].as_py(), dtype=np.int64)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                    names=["query", "block", "part", "cells"],
                )

    probes = stored(asked.repartition(shuffle_partitions(spark), "query").mapInArrow(probe, "query long, block long, part long, cells array<long>"), f"{folder}/probes")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_numpy()
            part = np.asarray(batch.column(0)) % parts_of[cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block_of[cells]), pa.array(part)], names=["id", "v", "cell", "block", "part"])

    in_blocks = placed.mapInArrow(put, f"id long, v array<{kind}>, cell long, block long, part long")
    # the queries of a block are cut into slices, each of which gets the block's entries
    n_slices = -F.floor(-F.col("n") / SLICE)
    per_block = probes.groupBy("block", "part").agg(F.count("*").alias("n"))
    sliced = probes.join(per_block, ["block", "part"]).withColumn("slice", F.pmod(F.xxhash64("query"), n_slices))
    slices = per_block.select("block", "part", F.explode(F.sequence(F.lit(0).cast("long"), n_slices - 1)).alias("slice"))
    left = sliced.join(asked, "query").select("block", "part", "slice", "query", "cells", "v")
    right = in_blocks.join(slices, ["block", "part"]).select("block", "part", "slice", "id", "cell", "v")

    def rerank(key, one: pa.Table, two: pa.Table) -> pa.Table:
        ids, cell, who = two.column("id").to_numpy(), two.column("cell").to_numpy(), one.column("query").to_numpy()
        found: list[list] = [[], [], []]
        if len(ids) and len(who):
            e, q, lists = _vectors(two.column("v").combine_chunks()), _vectors(one.column("v").combine_chunks()), one.column("cells").combine_chunks()
            for at in range(0, len(who), 64):
                seen = np.stack([np.isin(cell, lists[k_].values.to_numpy()) for k_ in range(at, min(at + 64, len(who)))])
                for k_, (places, score) in enumerate(best_of(q[at : at + 64], e, seen, k + 1)):  # one more, for the query's own row
                    best = np.lexsort((ids[places], -score))[: k + 1]
                    found[0].append(who[at + k_])
                    found[1].append(ids[places][best])
                    found[2].append(score[best])
        return pa.table({"query": pa.array(found[0], pa.int64()), "ids": pa.array(found[1], pa.list_(pa.int64())), "scores": pa.array(found[2], pa.list_(pa.float64()))})

    by = ["block", "part", "slice"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rerank, "query long, ids array<long>, scores array<double>")
    # each block gives a query k + 1 results at most
    found = found.select("query", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).select("query", "id", "score")
    found = found.groupBy("query").agg(F.collect_list(F.struct("id", "score")).alias("found"))  # k + 1 at most
    # every id that asked with this vector, each without its own row
    askers = usable(queries.select(F.col(id_column).alias("id"), F.col(vector).alias("q")), "id", "q", kind).distinct()
    askers = askers.join(asked.withColumnRenamed("query", "first"), "v").select(F.col("id").alias("query_id"), "first")
    rows = askers.join(found, askers["first"] == found["query"]).select("query_id", F.explode("found").alias("f")).where("f.id <> query_id")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("f.score"), "f.id"))
    return rows.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("f.id").alias("id"), F.col("f.score").alias("score"))
