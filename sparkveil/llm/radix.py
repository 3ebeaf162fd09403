"""An adaptive radix tree over byte keys: nodes grow from 4 to 16, 48 and 256 children as needed, and
a run of bytes without a branch is one edge (path compression)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Up to 4 or 16 children: their bytes in order, and the children beside them."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4):
        self.room, self.keys, self.nodes = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.keys, byte)
        return self.nodes[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.keys) < self.room:
            self.keys.insert(at, byte)
            self.nodes.insert(at, node)
            return self
        wider = Sorted(16) if self.room == 4 else Indexed()
        for key, child in self.items():
            wider.put(key, child)
        return wider.put(byte, node)

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.nodes, strict=True)


class Indexed:
    """Up to 48 children: a table of 256 places, 255 for none."""

    __slots__ = ("nodes", "place")
    room = 48

    def __init__(self):
        self.place, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, byte: int) -> Node | None:
        at = self.place[byte]
        return None if at == 255 else self.nodes[at]

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        at = self.place[byte]
        if at != 255:
            self.nodes[at] = node
            return self
        if len(self.nodes) < self.room:
            self.place[byte] = len(self.nodes)
            self.nodes.append(node)
            return self
        wider = Direct()
        for key, child in self.items():
            wider.put(key, child)
        return wider.put(byte, node)

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[at]) for byte, at in enumerate(self.place) if at != 255)


class Direct:
    """A child for each byte."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """`edge` leads to the node from its parent, its first byte included; `value` is set where a key ends."""

    __slots__ = ("branches", "edge", "value")

    def __init__(self, edge: bytes, value: object = None):
        self.edge, self.value = edge, value
        self.branches: Sorted | Indexed | Direct | None = None

    def add(self, child: Node) -> None:
        self.branches = (self.branches or Sorted()).put(child.edge[0], child)

    def children(self) -> list[Node]:
        """In order of their bytes."""
        return [node for _, node in self.branches.items()] if self.branches else []


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def at(self, key: bytes) -> Node:
        """The node where `key` ends, made if need be."""
        node, at = self.root, 0
        while at < len(key):
            child = node.branches.get(key[at]) if node.branches else None
            if child is None:
                fresh = Node(key[at:])
                node.add(fresh)
                return fresh
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same = _common(edge, key, at)
            # the edge parts here: a node comes between
            between = Node(edge[:same])
            child.edge = edge[same:]
            between.add(child)
            node.add(between)
            node, at = between, at + same
        return node


def _common(edge: bytes, key: bytes, at: int) -> int:
    """How many bytes of `edge` equal those of `key` from `at`."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[:middle] == key[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low
