"""Token ids in a compressed block format: static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks. A block holds whole
documents in ascending id order; its ids are dealt over interleaved lanes, each with its own
state, so that one numpy step codes one id of every lane. Blocks are independent, carry a checksum
and checkpoints of all lanes, and so decode in parallel, also from within.

A dataset is a folder of Parquet tables: `model` (the table), `blocks` (shard, block, bytes of the
format below, checksum) and `manifest` (ids before each shard). Spark's writer commits them, so a
lost executor leaves no half-written file.

Block: magic, lanes, documents, ids, rows between checkpoints, number of words, then little-endian
arrays: first id place per document, doc ids (and a null mark), final lane states, checkpoints
(word place, states), words; last a CRC-32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.llm.common import shared_folder, shuffle_partitions, slices, stored, text_of
from sparkveil.llm.pieces import PieceCache, byte_letters, splitter

MAGIC = b"svRANS1\0"
#: Bits of the frequency table's sum; a state stays in [2**31, 2**63) and moves 32 bits at a time.
BITS = 20
LOW = 31
#: Lanes of a block, ids after which it ends (with the document), coded rows between checkpoints.
LANES, BLOCK_IDS, EVERY = 1024, 1 << 18, 128
_HEAD = struct.Struct("<8sIIQIQ")


def normalised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits, in proportion to the counts."""
    total, size = 1 << bits, len(counts)
    if size > total:
        raise ValueError("more symbols than the table has room for")
    free = total - size
    weight = counts.astype(np.float64)
    share = np.floor(weight / max(weight.sum(), 1.0) * free).astype(np.int64)
    freq = 1 + share
    freq[int(np.argmax(counts))] += total - int(freq.sum())
    return freq


class Model:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        ends = np.cumsum(freq)
        self.start = (ends - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
        """Final states, checkpoints (words still to read before a row, states) and words."""
        rows = -(-len(ids) // lanes)
        grid = np.full(rows * lanes, int(np.argmax(self.freq)), dtype=np.int64)  # the padding is cut on reading
        grid[: len(ids)] = ids
        grid = grid.reshape(rows, lanes)
        state = np.full(lanes, 1 << LOW, dtype=np.uint64)
        chunks, written, marks = [], 0, []
        low, shift = np.uint64(BITS), np.uint64(32)
        room = np.uint64(LOW + 32 - BITS)
        for row in range(rows - 1, -1, -1):
            f, c = self.freq[grid[row]], self.start[grid[row]]
            full = state >= f << room
            out = state[full]
            chunks.append(out.astype(np.uint32))
            written += len(out)
            state[full] = out >> shift
            quotient = state // f
            state = (quotient << low) + (state - quotient * f) + c
            if row and row % every == 0:
                marks.append((written, state.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.empty(0, np.uint32)
        return state, [(written - w, s) for w, s in reversed(marks)], words

    def decode(self, n: int, state: np.ndarray, words: np.ndarray, place: int = 0, first_row: int = 0) -> np.ndarray:
        """Ids of the rows from `first_row` on, given the states and the word place there."""
        lanes = len(state)
        rows = -(-n // lanes)
        out = np.empty((rows - first_row, lanes), dtype=np.uint32)
        mask, low, shift, least = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(1 << LOW)
        state = state.copy()
        for row in range(rows - first_row):
            slot = state & mask
            ids = self.symbol[slot]
            out[row] = ids
            state = self.freq[ids] * (state >> low) + slot - self.start[ids]
            short = state < least
            k = int(short.sum())
            state[short] = (state[short] << shift) | words[place : place + k].astype(np.uint64)
            place += k
        return out.ravel()[: n - first_row * lanes]


def pack(model: Model, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One block of whole documents."""
    lengths = np.array([len(ids) for _, ids in docs], dtype="<u8")
    ids = np.concatenate([ids for _, ids in docs]) if docs else np.empty(0, np.int64)
    lanes = max(1, min(LANES, len(ids) // 64))  # small blocks take fewer lanes, whose states cost bytes
    state, marks, words = model.encode(ids, lanes)
    parts = [
        _HEAD.pack(MAGIC, lanes, len(docs), len(ids), EVERY, len(words)), lengths.tobytes(),
        np.array([0 if d is None else d for d, _ in docs], dtype="<i8").tobytes(), bytes(d is None for d, _ in docs),
        state.astype("<u8").tobytes(), *(struct.pack("<Q", w) + s.astype("<u8").tobytes() for w, s in marks), words.astype("<u4").tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(model: Model, block: bytes, checkpoint: int = 0) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, their lengths, and the ids from a checkpoint on (0: from the start)."""
    if struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("a block's checksum does not hold")
    magic, lanes, n_docs, n_ids, every, n_words = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = _HEAD.size
    lengths = np.frombuffer(block, "<u8", n_docs, at)
    at += 8 * n_docs
    docs = np.frombuffer(block, "<i8", n_docs, at)
    at += 8 * n_docs
    nulls = block[at : at + n_docs]
    at += n_docs
    state, place, row = np.frombuffer(block, "<u8", lanes, at), 0, 0
    at += 8 * lanes
    rows = -(-n_ids // lanes)
    marks = max(0, (rows - 1) // every)
    if checkpoint:
        if checkpoint > marks:
            raise ValueError("the block has no such checkpoint")
        there = at + (checkpoint - 1) * (8 + 8 * lanes)
        place, row = struct.unpack_from("<Q", block, there)[0], checkpoint * every
        state = np.frombuffer(block, "<u8", lanes, there + 8)
    at += marks * (8 + 8 * lanes)
    words = np.frombuffer(block, "<u4", n_words, at)
    ids = model.decode(n_ids, state.astype(np.uint64), words, place, row)
    return [None if gone else int(d) for d, gone in zip(docs, nulls, strict=True)], lengths.astype(np.int64), ids


@cache
def library_coder(path: str):
    """text -> ids as bytes (see `width`), by the tokenizers library's model, piece by piece.

    Merges never cross a piece, so each distinct piece is encoded once and remembered. Texts that
    hold a special token's mark go through the whole library.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kind = width(path)
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    letters = str.maketrans({byte: letter for letter, byte in byte_letters().items()})
    merge, code_type = tokenizer.model.tokenize, "H" if kind == "<u2" else "I"

    def encode(piece: str) -> bytes:
        return array(code_type, [t.id for t in merge(piece.encode("utf-8").decode("latin-1").translate(letters))]).tobytes()

    cache_, split = PieceCache(encode, limit=400_000), splitter()

    def code(text: str) -> bytes:
        if any(mark in text for mark in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=kind).tobytes()
        return b"".join(map(cache_.__getitem__, split(text)))

    return code


@cache
def width(path: str) -> str:
    """Two little-endian bytes per id where the vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, seen): ids of the whole text (null: empty) with the end id, as bytes (see `width`).

    The last row of each task has no ids but `seen`: how often its texts hold each id, as 64-bit integers.
    """
    names = ["doc_id", "ids", "seen"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = width(path)
        code, end = library_coder(path), np.array([end_id], dtype=kind).tobytes()
        seen = np.zeros(1 << 8 * np.dtype(kind).itemsize if kind == "<u2" else 0, dtype=np.int64)
        for batch in slices(batches):
            ids = [code(t) + end for t in batch.column(1).to_pylist()]
            more = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(seen))
            more[: len(seen)] += seen
            seen = more
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.trim_zeros(seen, "b").astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(add, "doc_id long, ids binary, seen binary")


def counted(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; one number per id of the vocabulary reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen in batch.column(0):
                n = np.frombuffer(seen.as_py(), "<i8")
                there = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["id", "n"])

    found = tokens.where("seen IS NOT NULL").select("seen").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode all documents into a dataset at `folder`, in ascending id order (null ids first).

    Rows with one id stand together, in the order of their ids' bytes.
    """
    spark = docs.sparkSession
    tokens = stored(tokenised(docs, path, end_id, id_column, text), f"{shared_folder(spark)}/tokens")
    kind = width(path)
    freq = normalised(counted(tokens))
    tokens = tokens.where("seen IS NULL").select("doc_id", "ids")
    model_rows = spark.createDataFrame([(int(k), int(f)) for k, f in enumerate(freq)], "id long, freq long")
    model_rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
    # splitters are ids and a digest, so one id given many times still spreads
    ordered = tokens.withColumn("digest", F.xxhash64("ids")).repartitionByRange(shuffle_partitions(spark), "doc_id", "digest")
    ordered = ordered.sortWithinPartitions("doc_id", "digest", "ids").select("doc_id", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, shard, number = Model(freq), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        names = ["shard", "block", "n_docs", "n_ids", "first_id", "data"]

        def block() -> pa.RecordBatch:
            row = [[shard], [number], [len(held)], [size], [held[0][0]], [pack(model, held)]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in slices(batches):
            for doc, ids in zip(batch.column(0), batch.column(1), strict=True):
                values = np.frombuffer(ids.as_py(), kind).astype(np.int64)
                held.append((doc.as_py(), values))
                size += len(values)
                if size >= BLOCK_IDS:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    blocks = ordered.mapInArrow(encode, "shard int, block long, n_docs long, n_ids long, first_id long, data binary")
    blocks.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{folder}/blocks")
    written = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "n_ids")
    # blocks are large: one small row each; sums per shard first, then over the shards in order
    shards = written.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0).cast("long")))
    manifest = starts.join(shards.select("shard", "shard_start"), "shard")
    manifest.select("shard", "block", (F.col("shard_start") + F.col("inside")).alias("start")).write.mode("overwrite").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n, ids): every document of a dataset, blocks decoded in parallel."""
    table = spark.read.parquet(f"{folder}/model").orderBy("id").collect()  # one row per id of the vocabulary
    freq = np.array([r["freq"] for r in table], dtype=np.int64)
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "data")
    placed = blocks.join(spark.read.parquet(f"{folder}/manifest"), ["shard", "block"]).select("start", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(freq)
        for batch in slices(batches):
            for start, data in zip(batch.column(0), batch.column(1), strict=True):
                docs, lengths, ids = unpack(model, data.as_py())
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(ends - lengths + start.as_py()), pa.array(lengths), pa.array(parts, pa.binary())], names=["doc_id", "start", "n", "ids"]
                )

    return placed.mapInArrow(decode, "doc_id long, start long, n long, ids binary")
