"""Adaptive radix trees: byte keys, nodes that grow with their children, compressed paths."""

from __future__ import annotations

from collections.abc import Iterator


class Few:
    """Up to ``room`` children, their bytes in order beside them (4, then 16)."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node):
        """This layout, or a larger one, with one more child."""
        if len(self.nodes) == self.room:
            wide = Few(16) if self.room == 4 else Indexed()
            for b, child in self.items():
                wide.put(b, child)
            return wide.put(byte, node)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple]:
        return zip(self.bytes, self.nodes, strict=True)


class Indexed:
    """Up to 48 children, found through a slot number for each byte."""

    __slots__ = ("slot", "nodes")

    def __init__(self):
        self.slot, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.slot[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node):
        if len(self.nodes) == 48:
            wide = Full()
            for b, child in self.items():
                wide.put(b, child)
            return wide.put(byte, node)
        self.nodes.append(node)
        self.slot[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator[tuple]:
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.slot) if at)


class Full:
    """A place for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple]:
        return ((b, x) for b, x in enumerate(self.nodes) if x is not None)


class Node:
    """``prefix`` follows the byte that led here; ``ends`` lists what was inserted with the key that stops after it."""

    __slots__ = ("prefix", "ends", "children")

    def __init__(self, prefix: bytes, ends: list | None = None, children=None):
        self.prefix, self.ends, self.children = prefix, ends or [], children or Few()


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            same = _common(node.prefix, key, at)
            if same < len(node.prefix):
                lower = Node(node.prefix[same + 1 :], node.ends, node.children)
                node.children = Few().put(node.prefix[same], lower)
                node.prefix, node.ends = node.prefix[:same], []
            at += same
            if at == len(key):
                node.ends.append(value)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children = node.children.put(key[at], Node(key[at + 1 :], [value]))
                return
            node, at = child, at + 1


def _common(prefix: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``prefix`` the key repeats from ``at`` on."""
    rest = key[at : at + len(prefix)]
    if rest == prefix:
        return len(prefix)
    return next((i for i, (a, b) in enumerate(zip(prefix, rest, strict=False)) if a != b), len(rest))
