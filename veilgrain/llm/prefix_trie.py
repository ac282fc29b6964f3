"""Conversation prefix trie from adaptive radix trees.

1. A turn becomes an id of fixed width, big endian: the digest of role and text and
   the length of the text. The ids of a conversation, one after the other, are its
   key. Equal keys are counted together before anything is sorted.
2. Keys are sorted over the cluster. Every task grows adaptive radix trees over
   stretches of its keys, of bounded size, and reads off the nodes: byte depths that
   end a turn, also inside a compressed path. What a node holds of its subtree is a
   sum over its members and over the nodes below it.
3. A node is in several trees only along the common prefix of the last key of one
   stretch and the first key of the next. A seam between the two takes off what both
   have counted (nodes, children, leaves); seams between tasks come from the first
   and last key of each task. The sum of the parts is then the sum over the tree.
4. The members that end in a node are joined in order, in runs of ids first, so that
   a conversation that occurs very often reaches its digest as few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.llm.hot import attach
from veilgrain.llm.radix_tree import RadixTree
from veilgrain.session import written

#: Bytes of a turn id: a digest, then the bytes of the text as a number.
DIGEST, WIDTH = 16, 20
#: Bytes of keys in one tree.
STRETCH = 4 << 20
#: Conversation ids in a run of members.
RUN = 4096
ROOT = bytes(16)

PART = pa.schema(
    [("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64())]
    + [("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]
    + [("task", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]
)
PART_SQL = (
    "path binary, parent binary, depth long, n long, conv_id long, kids long, leaves long, saved long, "
    "task long, first binary, last binary"
)


def _step(path: bytes, turn: bytes) -> bytes:
    """The name of the node that a turn leads to."""
    return hashlib.blake2b(path + turn, digest_size=16).digest()


def _turns(key: bytes) -> list[bytes]:
    return [key[i : i + WIDTH] for i in range(0, len(key), WIDTH)]


def _size(turn: bytes) -> int:
    return int.from_bytes(turn[DIGEST:], "big")


def seam(last: bytes, first: bytes) -> Iterator[tuple]:
    """What two neighbouring keys in different trees count twice, as parts to add."""
    shared = []
    for a, b in zip(_turns(last), _turns(first), strict=False):
        if a != b:
            break
        shared.append(a)
    # the last key is a leaf of its tree, but the next one goes on from it
    leaf = -int(len(shared) * WIDTH == len(last))
    path, parent = ROOT, None
    twice = sum(map(_size, shared))
    for depth in range(len(shared) + 1):
        yield path, parent, depth, 0, None, -int(depth < len(shared)), leaf, twice
        if depth < len(shared):
            if depth:
                twice -= _size(shared[depth - 1])
            parent, path = path, _step(path, shared[depth])


def tree_nodes(keys: list[tuple[bytes, int, int]]) -> Iterator[tuple]:
    """(path, parent, depth, n, conv_id, kids, leaves, saved) for every node of the tree over (key, n, least id)."""
    tree = RadixTree()
    for key, n, conv_id in keys:
        tree.insert(key, (n, conv_id))
    # down: the nodes that each radix node stands for, by the turns that its bytes complete
    found: dict[int, tuple] = {}
    order = []
    stack = [(tree.root, b"", ROOT, None, 0)]
    while stack:
        node, open_turn, path, parent, depth = stack.pop()
        text = open_turn + node.prefix
        made = [(path, parent, depth, 0)] if node is tree.root else []
        whole = len(text) // WIDTH * WIDTH
        for turn in _turns(text[:whole]):
            parent, path, depth = path, _step(path, turn), depth + 1
            made.append((path, parent, depth, _size(turn)))
        order.append((node, made))
        for byte, child in node.children.items():
            stack.append((child, text[whole:] + bytes([byte]), path, parent, depth))
    # up: sums over what lies below
    for node, made in reversed(order):
        n = sum(x for x, _ in node.ends)
        ids = [x for _, x in node.ends]
        below = [found.pop(id(child)) for _, child in node.children.items()]
        n += sum(x[0] for x in below)
        conv_id = min((x for x in ids + [x[1] for x in below] if x is not None), default=None)
        kids, leaves, saved = (sum(x[i] for x in below) for i in (2, 3, 4))
        if not below:
            leaves = 1
        for path, parent, depth, size in reversed(made):
            saved += (n - 1) * size
            yield path, parent, depth, n, conv_id, kids, leaves, saved
            kids = 1
        found[id(node)] = (n, conv_id, kids, leaves, saved)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PART.types, strict=True)], schema=PART)


def _grow(stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first, last = [], 0, None, None
        blank, edge = (None,) * 3, (None,) * 8

        def flush():
            rows = [(*x, *blank) for x in tree_nodes(held)]
            for at in range(0, len(rows), 1 << 15):
                yield _record(rows[at : at + (1 << 15)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first is None:
                    first = row[0]
                if size > stretch:
                    yield from flush()
                    yield _record([(*x, *blank) for x in seam(last, row[0])])
                    held, size = [], 0
                held.append(row)
                last, size = row[0], size + len(row[0]) + WIDTH
        if held:
            yield from flush()
            yield _record([(*edge, TaskContext.get().partitionId(), first, last)])

    return run


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for last, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield _record([(*x, None, None, None) for x in seam(last, first)])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node in which each key ends."""
    for batch in batches:
        paths = []
        for key in batch.column(1).to_pylist():
            path = ROOT
            for turn in _turns(key):
                path = _step(path, turn)
            paths.append(path)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.binary())], names=["conv_id", "key", "path"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, SHA-256 of the joined members) of runs that come in order."""
    open_path, digest, done = None, None, []
    for batch in batches:
        for path, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path != open_path:
                if digest is not None:
                    done.append((open_path, digest.hexdigest()))
                open_path, digest = path, hashlib.sha256(members.encode())
            else:
                digest.update(b"," + members.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "ends"])
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_path]), pa.array([digest.hexdigest()])], names=["path", "ends"])


def conversation_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, key) for each conversation: the hexadecimal ids of its turns in order, as an array.

    Null roles and texts become empty; null turns come first, equal turn numbers
    are ordered by role and text. Rows without a conv_id belong to no conversation.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = F.md5(F.concat(F.lpad(F.hex(F.octet_length("role")), 8, "0"), "role", "text"))
    turn_id = F.concat(own, F.lpad(F.lower(F.hex(F.octet_length("text"))), 8, "0"))
    rows = rows.select("conv_id", F.struct(F.row_number().over(order).alias("at"), turn_id.alias("turn_id")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["turn_id"]).alias("ids"))


def rebuilt(keys: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation with its first turns replaced by those of the one at the last multiple of ``every``.

    Conversation c takes the first h turns of conversation c - c % ``every`` (all if
    it has fewer, none if it is absent) and then its own after the first h, where h is
    the CRC-32 of the decimal c modulo ``heads``.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    source = keys.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = keys.select("conv_id", "ids", base.alias("base"), h.alias("h")).join(source, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("ids"))


def prefix_trie(keys: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per node of the trie over ``keys`` (conv_id, ids): each distinct sequence of first turns, and the root.

    conv_id, the least member; depth in turns; parent_conv_id, the least member of
    the parent (null for the root); n_convs, members; n_children; n_leaves, childless
    nodes of its subtree, itself included; saved_tokens, over its subtree, members
    less one times the UTF-8 bytes of the last text; ends_sha256 of the ids of the
    members that end here, in ascending order with commas. Without conversations
    there is no row. The ids of one conversation (20 bytes a turn) must fit a row.
    """
    key = F.unhex(F.array_join("ids", ""))
    members = written(keys.select("conv_id", key.alias("key")).mapInArrow(_paths, "conv_id long, key binary, path binary"), "members")
    distinct = written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "keys")
    ordered = distinct.repartitionByRange("key").sortWithinPartitions("key")
    parts = written(ordered.mapInArrow(_grow(stretch), PART_SQL), "parts")
    edges = parts.where("path is null").select("task", "first", "last")
    after = F.lead("first").over(Window.orderBy("task"))
    seams = edges.select("last", after.alias("first")).where("first is not null").mapInArrow(_seams, PART_SQL)
    nodes = parts.where("path is not null").unionByName(seams).groupBy("path", "parent", "depth")
    nodes = written(nodes.agg(*(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")), F.min("conv_id").alias("conv_id")), "nodes")
    runs = members.groupBy("path", F.floor(F.col("conv_id") / RUN).alias("run"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    runs = runs.agg(ids.alias("ids")).repartition("path").sortWithinPartitions("path", "run").select("path", "ids")
    ends = runs.mapInArrow(_digests, "path binary, ends string")
    parents = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "kids")
    total = parents.agg(F.sum("kids")).first()[0] or 0
    named = attach(nodes, parents.withColumnRenamed("kids", "weight"), "parent", "weight", total)
    return named.join(ends, "path", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
