"""SimHash groups, token links and prefix tries against plain Python."""

import gc
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veilgrain.llm import incidence, prefix_trie, radix_tree, simhash, token_links

DOCS = "doc_id long, text string, fp long, component string, n_rows string, pack long, pair long, stats string"


def table(spark, texts, start=0):
    """Documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, 1, "x", "x", 1, 1, "x") for i, t in enumerate(texts, start)], DOCS)


def plain_print(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, bits=2):
    label = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_simhash(spark):
    base = prose(1, 4000).split()
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 4000, 80)]
    texts += [None, "", " \n\t", "one", "ONE", "one two", "Ünï x\x0by z", prose(2, 70000), texts[0].upper(), texts[3]]
    prints = [plain_print(t) for t in texts]
    label = plain_groups(prints)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(table(spark, texts)).collect()}
    assert got == {i: (prints[i], label[i]) for i in range(len(texts))}
    assert len(set(label)) < len(set(prints)), "some texts of different fingerprints link"


def test_simhash_edges(spark):
    assert simhash.near_groups(table(spark, [])).count() == 0
    docs = table(spark, ["a b c d", None], 5)
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_groups(twice).collect())
    assert found == [(0, 5), (0, 6), (5, 5), (5, 5), (6, 6), (6, 6)]
    alone = simhash.near_groups(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert [r.component_id for r in alone] == [None, None]


def test_every_link_of_two_bits_is_found(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(s) for s in seeds} | {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(30):
            for n in (1, 2, 3):
                prints.add(int(s) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    prints = sorted(prints)
    label = plain_groups(prints)
    rows = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(rows, 40 * simhash.RANGE_ROWS).collect():
        parent[root(r.a % (1 << 64))] = root(r.b % (1 << 64))
    least = {}
    for p in prints:
        least.setdefault(root(p), p)
    assert [prints.index(least[root(p)]) for p in prints] == label


def test_a_crowded_list_is_searched_without_its_pairs():
    dense = np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)
    a, b = simhash._partners(dense, simhash.FREE.index((2, 3)))
    assert len(a) == (1 << 16) * (64 + 36) // 2
    assert np.all(np.bitwise_count(dense[a] ^ dense[b]) <= 2)
    assert np.all(simhash._stars(len(dense), a, b) == 0)


def plain_links(texts):
    """The columns of align_documents by whole-text encoding and plain loops."""
    pair, rows, docs = token_links.pair(token_links.FOLDER), [], Counter()
    for t in texts:
        links, row = Counter(), [0, 0, 0, 0, ""]
        raw = (" " + (t or "")).encode()
        a = pair.a.encode(" " + (t or ""), add_special_tokens=False).ids
        b = pair.b.encode(t or "")
        if t and b"".join(pair.a_bytes[i] for i in a) == raw == b"".join(pair.b_bytes[i] for i in b):
            ends = [list(itertools.accumulate(len(table[i]) for i in ids)) for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes))]
            groups, i, j = [], 0, 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                groups.append((a[i:x], b[j:y]))
                links.update(itertools.product(a[i:x], b[j:y]))
                i, j = x, y
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            row = [len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest()]
        rows.append((row, links))
        docs.update(links.keys())
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [
        (*r[:4], sum(w for k, w in m.items() if docs[k] == most[k[0]]), sum(w * docs[k] for k, w in m.items()), r[4]) for r, m in rows
    ]


PARTS = [" ", "  ", "\n", "\t", " \n", "\n\n", "a", "the", "word", " ist", "é", "über", "漢字", "😀", "́", "1234", "...", "'s", "▁", "<s>"]
PARTS += ["</s>", "<|endoftext|>", "<0x41>", "\xa0", "\x1c", "\r\n", "ﬁ", "--", "　", "\x85", "​", "नमस्ते", "x" * 300]


def test_token_links(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += [None, "", " ", "\n", "▁", prose(3, 6000), "word\n" * 2000, texts[7], texts[7]]
    want = plain_links(texts)
    got = {r.doc_id: tuple(r)[1:] for r in token_links.align_documents(table(spark, texts)).collect()}
    assert got == dict(enumerate(want))
    assert sum(w[0] > 0 for w in want) > 200


def test_token_links_edges(spark, monkeypatch):
    assert token_links.align_documents(table(spark, [])).count() == 0
    docs = table(spark, ["the word", None])
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    found = token_links.align_documents(twice).collect()
    assert sorted((r.doc_id is None, r.n_links > 0) for r in found) == [(False, False), (False, True), (True, False), (True, True)]
    assert {r.count_sum for r in found if r.n_links} == {2 * r.n_links for r in found if r.n_links}
    # many packs and a memo that is emptied all the time give the same
    monkeypatch.setattr(token_links, "PACK_BYTES", 50)
    monkeypatch.setattr(token_links, "PIECE_BYTES", 40)
    monkeypatch.setattr(token_links, "MEMO_BLOCKS", 3)
    texts = [prose(k, 30) for k in range(8)]
    links = token_links.Links(token_links.FOLDER)
    small = [token_links._documents(links, [t])[:2] for t in texts]
    monkeypatch.undo()
    stats, digests, _ = token_links._documents(token_links.Links(token_links.FOLDER), texts)
    assert [d for _, (d,) in small] == digests and np.array_equal(np.concatenate([s for s, _ in small]), stats)


def test_a_worker_hands_memory_back_after_each_pack(monkeypatch):
    """op12 ran out of an executor's memory: what a pack took stayed with the worker, beside the next one."""
    held = []
    monkeypatch.setattr(token_links, "PACK_BYTES", 400)
    monkeypatch.setattr(token_links, "PIECE_BYTES", 100)
    monkeypatch.setattr(token_links, "release", lambda: held.append(sum(isinstance(x, token_links._Pack) for x in gc.get_objects())), raising=False)
    monkeypatch.setattr(token_links, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [prose(k, 30) for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    packs = [r.column(1).to_pylist()[0] for r in token_links._pack(token_links.FOLDER)(iter([batch]))]
    assert sum(packs, []) == list(range(20)) and len(packs) > 3
    # once after each pack, when at most the next, empty one is there
    assert len(held) >= len(packs) and max(held) <= 1


def test_overlaps_are_the_bytes_in_common():
    for text in ("über naïve tokenisation 12345", "a  b\n\nc", "漢字かな"):
        pair = token_links.pair(token_links.FOLDER)
        (a,), (b,) = pair.encode([" " + text])
        spans = []
        for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
            ends = list(itertools.accumulate(len(names[i]) for i in ids))
            spans.append(list(zip([0, *ends], ends, strict=False)))
        want = [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1])]
        assert token_links.overlaps(text) == [x for x in want if x[2] > 0]
    assert token_links.overlaps("") == [] == token_links.overlaps("▁")


def test_sparse_product():
    rng = np.random.default_rng(1)
    for _ in range(20):
        dense = [rng.integers(0, 3, (rng.integers(1, 9), 6)), rng.integers(0, 3, (6, rng.integers(1, 9)))]
        sparse = [incidence.gathered(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in dense]
        out = incidence.product(*sparse)
        full = np.zeros((len(dense[0]), out.width), np.int64)
        full[out.rows(), out.columns] = out.values
        assert np.array_equal(full, dense[0] @ dense[1])


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else -1, len(who), kids[p], leaves[p], saved[p])
        + (hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),)
        for p, who in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, path string, ids string, n long, key string"


def spark_trie(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "x", 1, "x") for r in rows], TURNS)
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversation_keys(frame)), **options).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found)


@pytest.mark.parametrize("stretch", [0, 300, prefix_trie.STRETCH])
def test_prefix_trie(spark, stretch):
    rng = random.Random(3)
    roles, texts = ["user", None, ""], ["a", "b", "é" * 40, None, "", "long " * 3000]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    # one first turn, one whole conversation very often, and conversations that end inside others
    rows += [(c, t, "user", "hello" if t < 3 else rng.choice("xyz")) for c in range(100, 700) for t in range(rng.randrange(1, 8))]
    rows += [(c, t, "user", f"same {t}") for c in range(5000, 9200, 5) for t in range(4)]
    assert spark_trie(spark, rows, stretch=stretch) == plain_trie(rows)


def test_prefix_trie_edges(spark):
    assert spark_trie(spark, []) == []
    assert spark_trie(spark, [(None, 1, "user", "x")]) == []
    rows = [(3, 1, "user", "x")] * 2 + [(10**12, 5, None, None)]
    rows += [(9, k, "user", "deep") for k in range(250)] + [(8, k, "user", "deep") for k in range(240)]
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_radix_tree_layouts():
    rng = random.Random(1)
    keys = {bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 3, 9]))) for _ in range(4000)}
    keys |= {b"a" * n for n in range(40)}
    tree = radix_tree.RadixTree()
    for key in sorted(keys, key=lambda x: rng.random()):
        tree.insert(key, key)
    found, kinds, stack = [], set(), [(tree.root, b"")]
    while stack:
        node, path = stack.pop()
        path += node.prefix
        assert all(x == path for x in node.ends) and (node is tree.root or node.ends or len(list(node.children.items())) > 1)
        found += node.ends
        size = len(list(node.children.items()))
        kinds.add((type(node.children).__name__, getattr(node.children, "room", 0)))
        assert size <= {"Few": 16, "Indexed": 48, "Full": 256}[type(node.children).__name__]
        stack += [(child, path + bytes([b])) for b, child in node.children.items()]
    assert sorted(found) == sorted(keys)
    assert kinds == {("Few", 4), ("Few", 16), ("Indexed", 0), ("Full", 0)}
