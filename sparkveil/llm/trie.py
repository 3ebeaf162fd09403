"""The prefix trie of conversations, by adaptive radix trees over sorted blocks.

A turn's id is the first 16 bytes of a SHA-256 of its role and text; a conversation's key is the
ids of its turns one after the other. Keys are sorted over all partitions, equal keys by conversation
id, so a hot first turn or many copies of one conversation spread like any other keys. Each task
goes through its rows in blocks and builds one radix tree per block; only byte depths that are whole
turns become nodes.

A node whose members reach beyond its block lies on the path of the block's first or last key. Such
border nodes come out as parts and are put together afterwards: members and inner counts are summed
by node, and subtree totals over the border nodes follow by pointer jumping, in as many rounds as
the logarithm of the longest border path. All other nodes are complete where they are made.

Defined results: null role or text counts as empty; turns that tie are in order of their ids; rows
with a null conversation id belong to no conversation and are left out; an empty table gives no
nodes. One conversation is held by one task as ids and lengths, 24 bytes a turn, without its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import join_counted, shared_folder, shuffle_partitions, stored, text_of
from sparkveil.llm.radix import Node, RadixTree

#: Bytes of a turn id; turns and conversations of a block (a longer conversation is a block of its own).
ID_BYTES, BLOCK = 16, 60_000


def turn_id(role: Column, text: Column) -> Column:
    """The length of the role keeps role and text apart."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(F.encode(whole, "utf-8"), 256)), 1, ID_BYTES)


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): per conversation its turns in order (null first), as (turn, id, chars)."""
    one = F.struct(F.col(turn).cast("long").alias("turn"), turn_id(text_of(role), text_of(text)).alias("id"), F.char_length(text_of(text)).alias("chars"))
    rows = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


_PARTS = (
    "kind int, node binary, parent binary, parent_conv_id long, depth long, conv_id long, chars long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, ends_sha256 string"
)
#: Kinds of rows that a block gives: complete nodes under complete or border nodes, parts of border nodes, ends of border nodes.
INNER, RIM, PART, ENDS = range(4)


def _chain(key: bytes) -> list[bytes]:
    """The names of the nodes along a key: each is a digest of its parent's name and its turn."""
    names = [b"\0" * ID_BYTES]
    for at in range(0, len(key), ID_BYTES):
        names.append(hashlib.blake2b(names[-1] + key[at : at + ID_BYTES], digest_size=ID_BYTES).digest())
    return names


def _hex(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def block_nodes(convs: list[int], keys: list[bytes], chars: list[list[int]]) -> list[dict]:
    """The rows (see `_PARTS`) of one block of keys in order, equal keys by conversation id."""
    tree, size = RadixTree(), {}
    for conv, key, lengths in zip(convs, keys, chars, strict=True):
        node = tree.at(key)
        if node.value is None:
            node.value = []
            for k, n in enumerate(lengths):
                size[key[k * ID_BYTES : (k + 1) * ID_BYTES]] = n
        node.value.append(conv)
    rims = _chain(keys[0]), _chain(keys[-1])
    nodes: list[dict] = []
    # before their children: radix node, bytes before its edge, key bytes since the last whole turn, innermost trie node, on the first or last key's path
    todo: list[tuple[Node, int, bytes, int, bool, bool]] = [(tree.root, 0, b"", -1, True, True)]
    while todo:
        at, before, open_, above, first, last = todo.pop()
        path = open_ + at.edge
        start = before - len(open_)
        whole = len(path) // ID_BYTES
        turns = [path[k * ID_BYTES : (k + 1) * ID_BYTES] for k in range(whole)]
        if above < 0:
            turns = [b""]  # the root
        for k, turn in enumerate(turns):
            depth = start // ID_BYTES + k + 1 if above >= 0 else 0
            names = [chain for chain, on in zip(rims, (first, last), strict=True) if on]
            name = names[0][depth] if names else None
            parent = names[0][depth - 1] if names and depth else nodes[above]["node"] if above >= 0 else None
            nodes.append(
                {"kind": PART if name else INNER, "node": name, "parent": parent, "above": above, "depth": depth, "conv_id": None, "chars": size.get(turn, 0),
                 "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "own": []}
            )
            above = len(nodes) - 1
        if at.value is not None:
            nodes[above]["own"] = at.value
        below, rest = at.children(), path[whole * ID_BYTES :]
        for k in range(len(below) - 1, -1, -1):
            todo.append((below[k], before + len(at.edge), rest, above, first and k == 0 and at.value is None, last and k == len(below) - 1))
    rows: list[dict] = []
    for x in reversed(nodes):
        own = x.pop("own")
        x["n_convs"] += len(own)
        x["conv_id"] = min([c for c in (x["conv_id"], own[0] if own else None) if c is not None])
        if x["kind"] == INNER:
            x["n_leaves"] += x["n_children"] == 0
            x["saved_tokens"] += (x["n_convs"] - 1) * x["chars"]
            x["ends_sha256"] = _hex(own)
        elif own:
            rows.append({"kind": ENDS, "node": x["node"], "conv_id": own[0], "ends": ",".join(map(str, own))})
        if x["above"] >= 0:
            up = nodes[x["above"]]
            up["n_convs"] += x["n_convs"]
            up["conv_id"] = x["conv_id"] if up["conv_id"] is None else min(up["conv_id"], x["conv_id"])
            if x["kind"] == INNER:
                up["n_children"] += 1
                up["n_leaves"] += x["n_leaves"]
                up["saved_tokens"] += x["saved_tokens"]
    for x in nodes:
        if x["kind"] == INNER:  # the root is a border node
            up = nodes[x["above"]]
            if up["kind"] == PART:
                x["kind"] = RIM
            else:
                x["parent_conv_id"] = up["conv_id"]
    for x in nodes:
        del x["above"]
    return rows + nodes


def parts_of(sequences: DataFrame) -> DataFrame:
    """Rows (see `_PARTS`) of all blocks; `sequences` has conv_id, key and chars, sorted within its partitions."""
    schema = pa.schema(
        [("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary())]
        + [(c, pa.int64()) for c in ("parent_conv_id", "depth", "conv_id", "chars", "n_convs", "n_children", "n_leaves", "saved_tokens")]
        + [("ends", pa.string()), ("ends_sha256", pa.string())]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, keys, chars, held = [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            rows = block_nodes(convs, keys, chars)
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema)

        for batch in batches:
            for row in range(batch.num_rows):
                convs.append(batch.column(0)[row].as_py())
                keys.append(batch.column(1)[row].as_py())
                chars.append(batch.column(2)[row].as_py())
                held += 1 + len(chars[-1])
                if held >= BLOCK:
                    yield from block()
                    convs, keys, chars, held = [], [], [], 0
        if convs:
            yield from block()

    return sequences.select("conv_id", "key", "chars").mapInArrow(build, _PARTS)


def _totals(border: DataFrame, folder: str) -> DataFrame:
    """`border` with n_leaves and saved_tokens summed over each node's subtree of border nodes.

    In round k a node holds the sum of all border nodes less than 2**k below it, and a pointer to
    the one 2**k above; the sums of those 2**k below are added, and pointers jump.
    """
    now = stored(border.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), f"{folder}/totals-0")
    number = 0
    while not now.where("up IS NOT NULL").isEmpty():
        number += 1
        pointing = now.where("up IS NOT NULL")
        below = pointing.groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        # most pointers of a round lead to few nodes near the root
        up = join_counted(pointing.withColumn("spot", F.xxhash64("node")), now.select(F.col("node").alias("up"), F.col("up").alias("further")), "up", "spot").select("node", "further")
        more = lambda total, extra: (F.col(total) + F.coalesce(extra, F.lit(0))).alias(total)
        now = now.join(below, "node", "left").join(up, "node", "left").select("node", F.col("further").alias("up"), more("n_leaves", "more_leaves"), more("saved_tokens", "more_saved"))
        now = stored(now, f"{folder}/totals-{number}")
    return border.drop("n_leaves", "saved_tokens").join(now.select("node", "n_leaves", "saved_tokens"), "node")


def _ends(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of border nodes. Their ends come as texts in order, hashed one after the
    other; a digest of one long list has no other way, and holds one text at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k in range(batch.num_rows):
                this = batch.column(0)[k].as_py()
                if this != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = this, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(batch.column(1)[k].as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    rows = parts.where(F.col("kind") == ENDS).select("node", "conv_id", "ends")
    ordered = rows.repartition(shuffle_partitions(parts.sparkSession), "node").sortWithinPartitions("node", "conv_id")
    return ordered.select("node", "ends").mapInArrow(digest, "node binary, ends_sha256 string")


def build(sequences: DataFrame, salts: int = 16) -> DataFrame:
    """One row per trie node of `sequences` (conv_id, turns: array of (id, chars)).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    spark = sequences.sparkSession
    folder = shared_folder(spark)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.id)), ""))
    plain = stored(sequences.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t.chars).alias("chars")), f"{folder}/sequences")
    ordered = plain.repartitionByRange(shuffle_partitions(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = stored(parts_of(ordered), f"{folder}/parts")
    border = parts.where(F.col("kind") == PART).groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    border = stored(border, f"{folder}/border")
    below = border.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    border = border.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    border = border.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    border = stored(border.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")), f"{folder}/whole")
    border = stored(_totals(border, folder).join(_ends(parts), "node", "left"), f"{folder}/totals")
    # every parent of a complete node's rim is a border node; border nodes are few, so each is given to all salts
    spots = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    parents = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("of"), spots.alias("salt"))
    rim = parts.where(F.col("kind") == RIM).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))
    rim = rim.drop("parent_conv_id").join(parents, ["parent", "salt"]).withColumnRenamed("of", "parent_conv_id")
    edge = border.join(border.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tidy = lambda rows: rows.select(*columns, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    return tidy(parts.where(F.col("kind") == INNER)).unionByName(tidy(rim)).unionByName(tidy(edge))


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of c - c % family before its own after the first
    h, where h is crc32 of the decimal c, modulo `most`. A family is at most `family` rows."""
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")), F.lit(most)).cast("int")
    rows = turns.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    heads = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    empty = F.slice("turns", 1, 0)
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(empty)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", empty), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(empty)
    return rows.join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("turns"))
