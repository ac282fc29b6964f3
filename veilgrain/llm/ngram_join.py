"""Similarity self-join of documents on word n-grams: T-occurrence search with divided lists.

1. Every document becomes the sorted set of hashes of its word n-grams. Documents
   with one set are one node from here on.
2. Blocking, without loss. Two sets that are similar enough differ in at most d
   elements, so of more than d cells of the hash space at least one holds the same
   elements in both. Nodes with an equal cell meet in the block named by the least
   such node. Cells count only with all their elements, so frequent n-grams and
   passages shared by many documents do not gather unlike documents.
3. In a block every node searches the nodes before it through inverted lists: at
   least T of its lists must name a partner. The T - 1 longest lists are put aside,
   the others are merged with a heap, and what appears there is looked up in the
   long lists by binary search until it reaches or can no longer reach T.
   Partners already connected are not compared again: a block returns a spanning
   forest of its links, never its pairs. The first large component of a block has
   representatives; a set that one of them links stays away from its lists.
4. Components of these links are the components of all links.

Blocks of more than TILE_BYTES are dealt as pairs of tiles. Signatures travel
packed, by ranges of their value.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.llm.arrays import mix, pieces, release, shingle_hashes, word_hashes
from veilgrain.llm.graphs import components
from veilgrain.session import written

TILE_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
#: Text whose signatures travel together; larger pieces pack them better.
SEND_BYTES = 2 << 20
#: What is sent of a signature; in a bucket, so many bytes tell all but a few of its two million signatures apart,
#: and nodes that meet by mistake are compared like others.
SIGN_BYTES = 5
#: Bits that are left beside these in 64.
RANK_BITS = 64 - 8 * SIGN_BYTES


class Plan:
    """Cells for sets of each size, for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        lows, highs = [1], []
        while lows[-1] < 1 << 40:
            highs.append(100 * lows[-1] // percent)
            lows.append(highs[-1] + 1)
        self.lows, self.highs = np.array(lows[:-1]), np.array(highs)
        reach = 100 * self.highs // percent
        differ = (100 - percent) * (self.highs + reach) // (100 + percent)
        # cells left empty by the smallest set of a class and four standard deviations; small sets have few cells anyway
        spare = np.zeros(len(differ))
        for _ in range(20):
            cells = differ + 1 + spare
            empty = cells * np.exp(-self.lows / cells)
            spare = np.minimum(np.ceil(3 + empty + 4 * np.sqrt(empty)), np.maximum(3, differ // 2))
        self.spare = np.where(differ > 0, spare, 0).astype(np.int64)
        self.cells = np.where(differ > 0, differ + 1 + self.spare, 0)
        self.reach = reach

    def enough(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row of a piece, and where each row begins."""
    hashes, rows = shingle_hashes(*word_hashes(data, offsets), n)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def _node_keys(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One value for each set; the empty set has 0."""
    running = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=running[1:])
    counts = np.diff(firsts).astype(np.uint64)
    keys = mix((running[firsts[1:]] - running[firsts[:-1]]) + counts * np.uint64(0x2545F4914F6CDD1D))
    return np.where(counts > 0, keys, np.uint64(0))


def signatures(hashes: np.ndarray, firsts: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row): similar sets have at least one signature in common."""
    counts = np.diff(firsts)
    group = np.searchsorted(plan.lows, counts, side="right") - 1
    rows = np.repeat(np.arange(len(counts)), counts)
    spread = mix(hashes)
    found, owner = [], []
    for back in (0, 1):
        use = group - back
        on = (counts > 0) & (use >= 0)
        use = np.maximum(use, 0)
        on &= (plan.cells[use] > 0) & (counts <= plan.reach[use])
        k = np.where(on, plan.cells[use], 0)
        pick = np.flatnonzero(on[rows])
        if not len(pick):
            continue
        r = rows[pick]
        cell = ((hashes[pick] >> np.uint64(32)) * k[r].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(pick), bool)
        new[1:] = (r[1:] != r[:-1]) | (cell[1:] != cell[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(spread[pick], at)
        r, cell = r[at], cell[at]
        code = use[r].astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47) + cell * np.uint64(0xA24BAED4963EE407)
        found.append(mix(total + mix(code)))
        owner.append(r)
        full = np.bincount(r, minlength=len(counts))
        # where more cells are empty than there are to spare, the equal ones of two such sets may
        # all be empty; these sets also share one of their least elements
        sparse = on & (k - full > plan.spare[use])
        place = np.arange(len(hashes)) - firsts[rows]
        least = np.flatnonzero(sparse[rows] & (place <= counts[rows] + -plan.percent * counts[rows] // 100))
        found.append(mix(spread[least] + mix(use[rows[least]].astype(np.uint64) + np.uint64(1 << 40))))
        owner.append(rows[least])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose i-th element holds values[cuts[i]:cuts[i + 1]]."""
    at = (cuts * (values.nbytes // max(1, len(values)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def cropped(signs: np.ndarray) -> np.ndarray:
    """The low SIGN_BYTES of each signature, a row of bytes each."""
    return signs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIGN_BYTES]


def restored(blob: np.ndarray) -> np.ndarray:
    """The numbers that cropped() made bytes of."""
    out = np.zeros((len(blob) // SIGN_BYTES, 8), np.uint8)
    out[:, :SIGN_BYTES] = blob.reshape(-1, SIGN_BYTES)
    return out.view("<u8").ravel()


SENT = pa.schema(
    [("bucket", pa.int32()), ("signs", pa.binary()), ("nodes", pa.binary()), ("runs", pa.binary())]
    + [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64())]
)
SENT_SQL = "bucket int, signs binary, nodes binary, runs binary, doc_id long, n long, node long"


def _send(plan: Plan, n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1), SEND_BYTES):
                hashes, firsts = shingle_sets(data, offsets, n)
                node = _node_keys(hashes, firsts).view(np.int64)
                count = last - first
                blank = pa.nulls(count, pa.binary())
                home = (node.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home), blank, blank, blank, batch.column(0).slice(first, count), pa.array(np.diff(firsts)), pa.array(node)],
                    schema=SENT,
                )
                signs, rows = signatures(hashes, firsts, plan)
                if not len(signs):
                    continue
                to = (((signs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
                order = np.lexsort((rows, to))
                signs, rows, to = signs[order], rows[order], to[order]
                new = np.ones(len(to), bool)
                new[1:] = (to[1:] != to[:-1]) | (rows[1:] != rows[:-1])
                run_at = np.flatnonzero(new)
                lengths = np.diff(np.r_[run_at, len(to)]).astype(np.int32)
                head = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                cuts, run_cuts = np.r_[head, len(to)], np.r_[np.searchsorted(run_at, head), len(run_at)]
                size = len(head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[head]), packed(cropped(signs), cuts), packed(node[rows[run_at]], run_cuts), packed(lengths, run_cuts)]
                    + [pa.nulls(size, pa.int64())] * 3,
                    schema=SENT,
                )

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The values packed in all cells of a binary column, in order; null cells hold none."""
    parts = []
    for chunk in column.chunks:
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if data is not None and at[-1] > at[0]:
            parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes())
    return np.frombuffer(b"".join(parts), kind)


MET_SQL = "head long, node long, doc_id long, n long"
MET = pa.schema([("head", pa.int64()), ("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])


def meetings(signs: np.ndarray, nodes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """(head, member), each once: of every signature that several nodes have, the least of them and all of them.

    The first runs[0] signatures are of nodes[0], the next runs[1] of nodes[1], and so on.
    """
    names, rank = np.unique(nodes, return_inverse=True)
    rank = np.repeat(rank.astype(np.uint64), runs)
    if len(names) <= 1 << RANK_BITS:
        # signature and rank become one number, sorted in place
        rank |= signs << np.uint64(RANK_BITS)
        rank.sort()
        both = rank[_fresh(rank)]
        both = both[_shared(both >> np.uint64(RANK_BITS))]
        signs, rank = both >> np.uint64(RANK_BITS), both & np.uint64((1 << RANK_BITS) - 1)
    else:
        order = np.lexsort((rank, signs))
        signs, rank = signs[order], rank[order]
        fresh = _fresh(signs) | _fresh(rank)
        signs, rank = signs[fresh], rank[fresh]
        shared = _shared(signs)
        signs, rank = signs[shared], rank[shared]
    at = np.flatnonzero(_fresh(signs))
    head = np.repeat(rank[at], np.diff(np.r_[at, len(rank)]))
    return names[np.unique(np.stack([head, rank], axis=1), axis=0).astype(np.int64)]


def _fresh(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _shared(ordered: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array comes more than once."""
    fresh = _fresh(ordered)
    return ~(fresh & np.r_[fresh[1:], True][: len(fresh)])


def _meet(table: pa.Table) -> pa.Table:
    """Of one range of signatures: documents as they came, and (head, node) where nodes share a signature."""
    docs = table.select(["doc_id", "n", "node"]).filter(table["node"].is_valid())
    signs, nodes, runs = (_joined(table[x], kind) for x, kind in (("signs", np.uint8), ("nodes", np.int64), ("runs", np.int32)))
    pairs = meetings(restored(signs), nodes, runs)
    met = pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int64())], schema=MET)
    seen = pa.table([pa.nulls(len(docs), pa.int64()), docs["node"], docs["doc_id"], docs["n"]], schema=MET)
    release()
    return pa.concat_tables([met, seen])


def shared_only(sets: list[np.ndarray]) -> list[list[int]]:
    """The elements of each set that another set of the block has too, renamed to small numbers."""
    flat = np.concatenate(sets)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[name] > 1
    cuts = np.cumsum([0, *map(len, sets)])
    return [name[a:b][keep[a:b]].tolist() for a, b in itertools.pairwise(cuts)]


#: A component of this many sets gets representatives; of these there are at most so many.
CROWD, REPRESENTATIVES = 16, 64


class _Block:
    """Inverted lists over the sets of a block; those of the first large component are kept apart.

    A set that a representative of the large component links need not look among its
    members, so copies of one text do not wade through each other's lists.
    """

    def __init__(self, sizes: list[int], sets: list[list[int]], plan: Plan):
        self.sizes, self.sets, self.plan = sizes, sets, plan
        self.parent = list(range(len(sets)))
        self.members = {}
        self.index: dict[int, list[int]] = {}
        self.crowd_index: dict[int, list[int]] = {}
        self.crowd: int | None = None
        self.leaders: list[tuple[int, set[int]]] = []
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        """Join two components; the large one takes in the lists of the other."""
        self.links.append((a, b))
        a, b = self.root(a), self.root(b)
        crowd = None if self.crowd is None else self.root(self.crowd)
        low, high = (a, b) if len(self.members[a]) >= len(self.members[b]) else (b, a)
        if crowd in (a, b):
            self.move(self.members[b if crowd == a else a])
        self.parent[high] = low
        self.members[low] += self.members.pop(high)
        if self.crowd is None and len(self.members[low]) >= CROWD:
            self.crowd = low
            self.move(self.members[low])
            self.leaders = [(low, set(self.sets[low]))]

    def move(self, members: list[int]) -> None:
        for who in members:
            for x in self.sets[who]:
                entries = self.index.get(x)
                at = bisect_left(entries, who) if entries else 0
                if entries and at < len(entries) and entries[at] == who:
                    del entries[at]
                    if not entries:
                        del self.index[x]
                insort(self.crowd_index.setdefault(x, []), who)

    def add(self, me: int) -> None:
        own = self.sets[me]
        self.members[me] = [me]
        led = self.led(me, own)
        self.look(me, [self.index[x] for x in own if x in self.index])
        if self.crowd is not None and self.root(me) != self.root(self.crowd):
            self.look(me, [self.crowd_index[x] for x in own if x in self.crowd_index])
        if self.crowd is not None and not led:
            if len(self.leaders) < REPRESENTATIVES and self.root(me) == self.root(self.crowd):
                self.leaders.append((me, set(own)))
        # a set that has joined the large component is in its lists by now
        if self.crowd is None or self.root(me) != self.root(self.crowd):
            for x in own:
                self.index.setdefault(x, []).append(me)

    def led(self, me: int, own: list[int]) -> bool:
        """Whether a representative of the large component links this set."""
        mine = set(own)
        for k, (who, theirs) in enumerate(self.leaders):
            if self.plan.enough(len(mine & theirs), self.sizes[me], self.sizes[who]):
                self.leaders[0], self.leaders[k] = self.leaders[k], self.leaders[0]
                self.link(who, me)
                return True
        return False

    def look(self, me: int, lists: list[list[int]]) -> None:
        """Heap-merge the short lists, probe the longest T - 1, and link what is similar."""
        need = max(1, -(-self.plan.percent * self.sizes[me] // 100))
        lists = sorted(lists, key=len)
        aside = need - 1
        if len(lists) < need:
            return
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        counted = [(len(list(same)), who) for who, same in itertools.groupby(heapq.merge(*short))]
        # links move entries between lists, so what is found is linked after the search
        found = []
        for count, who in sorted(counted, reverse=True):
            size = self.sizes[who]
            if 100 * size < self.plan.percent * self.sizes[me] or self.root(who) == self.root(me):
                continue
            if any(self.root(who) == self.root(x) for x in found[-1:]):
                continue
            least = -(-self.plan.percent * (self.sizes[me] + size) // (100 + self.plan.percent))
            left = len(long)
            for entries in long:
                if count + left < least:
                    break
                left -= 1
                at = bisect_left(entries, who)
                count += at < len(entries) and entries[at] == who
            if self.plan.enough(count, self.sizes[me], size):
                found.append(who)
        for who in found:
            if self.root(who) != self.root(me):
                self.link(who, me)


def search(sizes: list[int], sets: list[list[int]], plan: Plan) -> list[tuple[int, int]]:
    """Links that connect all sets of a block which links connect; sets ascend by size."""
    block = _Block(sizes, sets, plan)
    for me in range(len(sets)):
        block.add(me)
    return block.links


def _search_pack(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        blocks: dict[tuple, dict[int, bytes]] = {}
        for head, i, j, node, blob in zip(*(table[c].to_pylist() for c in ("head", "i", "j", "node", "grams")), strict=True):
            blocks.setdefault((head, i, j), {})[node] = blob
        a, b = [], []
        for key in sorted(blocks):
            members = sorted(blocks[key].items(), key=lambda x: (len(x[1]), x[0]))
            grams = [np.frombuffer(x, np.uint64) for _, x in members]
            for left, right in search([len(x) for x in grams], shared_only(grams), plan):
                a.append(members[left][0])
                b.append(members[right][0])
        blocks.clear()
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(n: int):
    out = pa.schema([("node", pa.int64()), ("grams", pa.binary()), ("blocks", pa.list_(pa.struct([("head", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("pack", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(0)):
                hashes, firsts = shingle_sets(data, offsets, n)
                rest = [batch.column(k).slice(first, last - first).cast(out.field(x).type) for k, x in ((1, "node"), (2, "blocks"))]
                same = pa.array(_node_keys(hashes, firsts).view(np.int64) == rest[0].to_numpy())
                yield pa.RecordBatch.from_arrays([rest[0], packed(hashes, firsts), rest[1]], schema=out).filter(same)

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Words are runs free of ASCII white space, A-Z lower-cased; the set of a text is
    its distinct n-word shingles, or all its words as one where there are fewer.
    Texts link when 100 * intersection >= percent * union. ``component_id`` is the
    least id reachable by links, the own id where there is none. A null or blank text
    has no shingles and no links. Rows with a null id take part; they never name a
    component, unless all its ids are null (then null). Repeated rows give repeated results.
    """
    plan = Plan(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    sent = rows.mapInArrow(_send(plan, n, buckets), SENT_SQL)
    met = written(sent.groupBy("bucket").applyInArrow(_meet, MET_SQL), "met", compression="zstd")
    seen = met.where("head is null").select("doc_id", "n", "node")
    nodes = seen.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    members = written(met.where("head is not null").select("head", "node").distinct().join(nodes, "node"), "members", compression="zstd")
    sizes = members.groupBy("head").agg((8 * F.sum("n")).alias("bytes"))
    placed = members.join(sizes, "head").withColumn("tiles", F.ceil(F.col("bytes") / TILE_BYTES).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packs = max(1, math.ceil((members.agg(F.sum(8 * F.col("n"))).first()[0] or 0) / TILE_BYTES))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    i, j = F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    pack = F.pmod(F.xxhash64("head", i, j), F.lit(packs)).cast("int").alias("pack")
    places = placed.groupBy("node", "rep").agg(F.collect_set(F.struct("head", i, j, pack)).alias("blocks"))
    texts = rows.join(places.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "node", "blocks")
    block = "struct<head:long,i:int,j:int,pack:int>"
    sets = texts.mapInArrow(_sets(n), f"node long, grams binary, blocks array<{block}>")
    spread = sets.select("node", "grams", F.explode("blocks").alias("k")).select("node", "grams", "k.*")
    links = spread.groupBy("pack").applyInArrow(_search_pack(plan), "a long, b long")
    groups = components(written(links, "links"), "a", "b")
    labelled = nodes.join(groups, F.col("node") == F.col("vertex"), "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    labelled = labelled.withColumn("label", F.col("c"))
    names = labelled.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = labelled.join(names, "c").select("node", "component_id")
    out = seen.join(named, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
