"""The operators for training data against plain Python on small tables, with nulls, ties, repeats and empty input."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrain.llm import boilerplate, decontaminate, fingerprints, languages, licenses, ngram_join, packing, quality, secrets, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n long, hash string, part string, score string"
WORDS = "alder birch cedar dogwood elm fir gum hazel ironwood juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def table(spark, texts, start=0, source="s"):
    """Documents with columns whose names clash with those inside the operators."""
    rows = [(i, t, "en", source, len(t or ""), "x", 1, "x", "x", "x") for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"zz{rng.randrange(999)}" if rng.random() < share else w for w in text.split())


def corpus():
    base = prose(1, 120)
    texts = [base, base, edited(base, 2, 0.01), edited(base, 3, 0.03), edited(base, 4, 0.08), prose(5, 90), None, "", " \n", "one two", "one  TWO", "one two three"]
    texts += [prose(6, 3000), "pad " * 500, "pad " * 501, base.upper(), base + " " + prose(7, 10), "ünïcode " + prose(8, 60)]
    return texts + [edited(prose(9, 200), s, 0.02) for s in range(12)]


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_near_groups(spark, n, percent):
    texts = corpus()
    sets = [shingles(t, n) for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(table(spark, texts), n=n, percent=percent).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_near_groups_edges(spark):
    assert ngram_join.near_groups(table(spark, [])).count() == 0
    docs = table(spark, ["a b c d e f"])
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    got = ngram_join.near_groups(twice).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 0), (False, 0), (True, 0)]


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_every_similar_pair_shares_a_signature(percent):
    rng = np.random.default_rng(percent)
    plan = ngram_join.Plan(percent)
    for size in (1, 3, 6, 7, 12, 25, 60, 130, 400, 2000):
        for _ in range(20):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            least = -(-percent * size // 100)
            b = np.concatenate([a[: rng.integers(least, size + 1)], rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if not plan.enough(common, len(a), len(b)) or size == common == len(b):
                continue
            both = [ngram_join.signatures(np.sort(x), np.array([0, len(x)]), plan)[0] for x in (a, b)]
            assert len(np.intersect1d(*both))


@pytest.mark.parametrize("bits", [24, 3])
def test_meetings(monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "RANK_BITS", bits)
    rng = np.random.default_rng(5)
    for runs in ([], [3], [0, 2], rng.integers(0, 9, 40)):
        nodes = rng.integers(-9, 9, len(runs)) * 7
        signs = rng.integers((1 << 40) - 60, 1 << 40, int(sum(runs))).astype(np.uint64)
        held = {}
        for sign, node in zip(signs.tolist(), np.repeat(nodes, np.array(runs, int)).tolist(), strict=True):
            held.setdefault(sign, set()).add(node)
        want = {(min(x), node) for x in held.values() if len(x) > 1 for node in x}
        got = ngram_join.meetings(signs, nodes.astype(np.int64), np.array(runs, np.int32))
        assert sorted(want) == [tuple(x) for x in got.tolist()]


def test_signatures_travel_in_few_bytes():
    signs = np.random.default_rng(6).integers(0, 1 << 63, 50, dtype=np.uint64)
    cuts = np.array([0, 20, 20, 50])
    blob = ngram_join.packed(ngram_join.cropped(signs), cuts)
    assert [len(x) for x in blob.to_pylist()] == [20 * 5, 0, 30 * 5]
    back = ngram_join.restored(ngram_join._joined(pa.chunked_array([blob]), np.uint8))
    assert back.tolist() == (signs % (1 << 40)).tolist()
    assert ngram_join.restored(np.zeros(0, np.uint8)).tolist() == []


def test_meeting_takes_little_memory():
    rng = np.random.default_rng(7)
    signs = rng.integers(0, 1 << 63, 1 << 20, dtype=np.uint64)
    nodes = rng.integers(-(1 << 62), 1 << 62, 1 << 13)
    columns = {
        "signs": ngram_join.packed(ngram_join.cropped(signs), np.array([0, len(signs)])),
        "nodes": ngram_join.packed(nodes, np.array([0, len(nodes)])),
        "runs": ngram_join.packed(np.full(len(nodes), 128, np.int32), np.array([0, len(nodes)])),
    }
    none = pa.nulls(1, pa.int64())
    table = pa.table([pa.array([0], pa.int32()), *columns.values(), none, none, none], schema=ngram_join.SENT)
    tracemalloc.start()
    ngram_join._meet(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * signs.nbytes


def brute_spans(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("tile", [2 << 20, 700])
def test_remove_repeats(spark, monkeypatch, tile):
    monkeypatch.setattr(suffix_dedup, "TILE_BYTES", tile)
    shared = prose(11, 60)
    texts = corpus() + [prose(12, 30) + shared + prose(13, 30), prose(14, 20) + shared, "ab" * 300, "x" + "ab" * 200 + "y", "a" * 199, "a" * 200, "a" * 201, "é" * 150, "é" * 150]
    raw = [(t or "").encode() for t in texts]
    want = brute_spans(raw, 200)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    for i, (runs, kept) in enumerate(want):
        assert [(s.start, s.end) for s in got[i].spans] == runs
        assert bytes(got[i].kept) == kept
        assert (got[i].n_bytes, got[i].n_removed) == (len(raw[i]), len(raw[i]) - len(kept))


def test_remove_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    docs = table(spark, [prose(1, 60)])
    assert [r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()] == [0]
    assert all(r.n_removed == r.n_bytes for r in suffix_dedup.remove_repeats(docs.unionByName(docs)).collect())


def test_window_sort_matches_counting():
    rng = random.Random(0)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"abc" * 400 + bytes(rng.choice(b"ab") for _ in range(500)) * 2
    at = np.arange(len(text) - 80 + 1)
    count = Counter(text[i : i + 80] for i in at)
    assert suffix_dedup.repeated_windows(np.frombuffer(text, np.uint8), at, 80).tolist() == [count[text[i : i + 80]] > 1 for i in at]


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 3000)
    texts = corpus()
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        text, following = text or "", texts[i - 1] or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + following[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        if len(text) > 300:
            assert got[i].near_edited > 0.4
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1
    assert len({got[i].fingerprint for i in range(len(texts))}) == len({t or "" for t in texts})
    assert fingerprints.fingerprints(table(spark, [])).count() == 0
    alone = fingerprints.fingerprints(table(spark, ["abcdef"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_trees_locate_edits_and_compare_over_levels():
    text = "\n".join(prose(s, 30) for s in range(20)) + "\n\n" + prose(99, 30)
    a, b = [m.span() for m in re.finditer(r"\S+", text)][300]
    other = text[:a] + "changed" + text[b:]
    fine, coarse = (fingerprints.trees(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), width)[0] for width in (400, 20))
    assert fingerprints.likeness(fine, coarse) == 1
    changed = fingerprints.trees(np.frombuffer(other.encode(), np.uint8), np.array([0, len(other)]), 400)[0]
    assert fingerprints.tree_of(fingerprints.text_of(changed))[2].tolist() == changed[2].tolist()
    where = fingerprints.edits(fine, changed)
    assert 0 < len(where) <= 3 and abs(where[0] / len(fine[2]) - 300 / 630) < 0.1
    assert 0.95 < fingerprints.likeness(fine, changed) < 1


HEX = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]


def test_secrets(spark):
    texts = [f"see token = \"{h}\" here" for h in HEX]
    texts += [None, "", "token=short", "Secret:\x20\x20'ABCdef123' x", "secret: token = abcdef", "PASSWD:" + "x" * 5, "AKIA" + "Q7" * 8, "AKIAQ", "paſſword=abcdefgh", "ÄÖ api_key=a.b/c=d+ é", "f" * 24, "f" * 23 + "g"]
    texts += ["the value " + HEX[0][:20].upper(), "an ordinary-hyphenated-phrase-of-words here"]
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(table(spark, texts)).collect()}
    at = len(HEX)
    assert [k for k, _, _ in rows[0]] == ["assign", "hex"]
    assert texts[0][rows[0][0][1] : rows[0][0][2]] == f'token = "{HEX[0]}'
    want = [[], [], [], [("assign", 0, 19)], [], [], [("access", 0, 20)], [], [], [("assign", 3, 19)], [("hex", 0, 24)], []]
    assert [[x for x in rows[at + k] if x[0] != "format"] for k in range(len(want))] == want
    assert rows[at + 13] == []
    assert secrets.find_secrets(table(spark, [])).count() == 0


def test_automaton_prefers_its_format():
    words = HEX[:50]
    model, other = secrets.Automaton(words), secrets.Background(["ordinary-words1-with-a-dash", "another/path/of2/words"])
    assert len(model.states) < 20
    assert all(model.log_likelihood(w) > other.log_likelihood(w) for w in HEX[50:])
    assert -np.inf < model.log_likelihood("zz-not-hex-at-all") < other.log_likelihood("zz-not-hex-at-all")


def test_quality(spark):
    good = [prose(s, 80) for s in range(60)]
    bad = [" ".join(w + "###" for w in prose(s, 80).split()) for s in range(60)]
    docs = table(spark, good + bad + [None, "", "word"])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == 123 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(120) if got[i].held_out]
    assert 20 < len(held) < 60
    assert np.mean([got[i].predicted == int(i < 60) for i in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}
    assert {r.score for r in quality.score_quality(docs, labels.where("quality = 1")).collect()} != set()
    assert quality.score_quality(table(spark, []), labels).count() == 0


def test_scores_ignore_ids_and_labels_of_the_held_out(spark):
    docs = table(spark, [prose(s, 40) if s % 2 else "!! ## " * 20 + str(s) for s in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = (sorted((r.doc_id, r.score) for r in quality.score_quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_decontaminate(spark):
    items = [prose(100 + s, 30) for s in range(6)] + ["tiny item", "six words make one short item", None]
    tests = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, words string")
    changed = items[1].split()
    for k in (4, 11, 19, 26):
        changed[k] = "other"
    gap = items[2].split()
    gap[15:15] = ["put", "in"]
    texts = [prose(1, 50) + " " + items[0] + " " + prose(2, 20), " ".join(changed), " ".join(gap), prose(3, 400), " ".join(items[3].split()[:8]), None, "", items[4].upper() + " " + items[5], "so: Six words make one short item", "tiny item"]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table(spark, texts), tests).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (7, 4), (7, 5), (8, 7)}
    assert (found[0, 0].start, found[0, 0].end, found[0, 0].matched) == (50, 80, 30)
    assert found[1, 1].matched == 26 and found[2, 2].matched == 30
    assert decontaminate.contaminated(table(spark, []), tests).count() == 0
    assert decontaminate.contaminated(table(spark, texts), tests.limit(0)).count() == 0


def brute_contaminated(text, item, identity=0.7, share=0.5, words=13, least=5):
    """Agreeing words of all stretches of all diagonals."""
    text, item = text.lower().split(), item.lower().split()
    hit = set()
    for shift in range(-len(item), len(text)):
        same = [0 <= i + shift < len(text) and w == text[i + shift] for i, w in enumerate(item)]
        low, high = max(0, -shift), min(len(item), len(text) - shift)
        for a in range(low, high):
            for b in range(a + least, high + 1):
                on = [i for i in range(a, b) if same[i]]
                if len(on) >= least and len(on) * 10 >= round(identity * 10) * (b - a):
                    hit.update(on)
    return len(hit) if len(hit) >= least and (len(hit) >= words or len(hit) >= share * len(item)) else None


def test_decontaminate_misses_no_substituted_item(spark):
    rng = random.Random(11)
    sizes = (5, 6, 7, 8, 9, 10, 13, 15, 20, 25, 30, 40)
    items = [prose(500 + k, n) for k, n in enumerate(sizes * 2)]
    texts = []
    for k, item in enumerate(items):
        n = len(item.split())
        for cut in {0, 1, n // 5, n * 3 // 10, n * 3 // 10 + 1}:
            for _ in range(3):
                changed = item.split()
                for at in rng.sample(range(n), cut):
                    changed[at] = "other"
                texts.append(prose(900 + k, 7) + " " + " ".join(changed) + " " + prose(950 + k, 5))
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(table(spark, texts), tests).collect()}
    want = {(d, i): brute_contaminated(t, item) for d, t in enumerate(texts) for i, item in enumerate(items)}
    assert found == {k: v for k, v in want.items() if v}


def test_masks_fit_every_stretch():
    for n in range(5, 14):
        for same in itertools.product((0, 1), repeat=n):
            if sum(same) >= 5 and sum(same) * 10 >= 7 * n:
                assert any(all(same[a + k] for k, on in enumerate(m) if on == "1") for m in decontaminate.MASKS for a in range(n - len(m) + 1))


def test_boilerplate(spark):
    texts = [f"page {i}\nmenu\n\nfoot" if i < 8 else f"page {i}\nmenu\nmenu" for i in range(10)] + [None, "", "menu"]
    docs = table(spark, texts).unionByName(table(spark, ["menu\nown"], 50, None))
    got = {r.doc_id: r for r in boilerplate.drop_boilerplate(docs, ratio=0.65).collect()}
    assert got[0].text == "page 0\n\nfoot" and (got[0].n_lines, got[0].n_dropped) == (4, 1)
    assert got[9].text == "page 9" and got[9].n_dropped == 2
    assert got[10].text is None and got[10].n_lines == 0 and got[11].text == "" and got[12].text == ""
    assert got[50].text == "menu\nown"
    assert set(docs.columns) <= set(boilerplate.drop_boilerplate(docs).columns)
    assert boilerplate.drop_boilerplate(table(spark, [])).count() == 0


def brute_pack(sizes, capacities, overhead):
    """Best fit over every opening rule by scanning all bins."""
    best = None
    for rule in packing.openings(capacities):
        bins = []
        for s in sizes:
            fits = [b for b in bins if b[0] >= s]
            if fits:
                b = min(fits, key=lambda x: x[0])
            else:
                b = [rule[next(k for k, c in enumerate(capacities) if c >= s)], 0]
                bins.append(b)
            b[0] -= s
            b[1] += s
        cost = sum(next(c for c in capacities if c >= b[1]) + overhead for b in bins)
        best = cost if best is None else min(best, cost)
    return best


def test_best_fit_cost():
    rng = random.Random(3)
    for _ in range(40):
        sizes = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(1, 40))), reverse=True)
        where, final, cost = packing.pack(sizes, (8, 16, 32, 64), 3)
        used = Counter()
        for b, s in zip(where, sizes, strict=True):
            used[b] += s
        assert all(used[b] <= final[b] and (final[b] == 8 or used[b] > final[b] // 2) for b in used)
        assert cost == brute_pack(sizes, (8, 16, 32, 64), 3)


def test_packing_round_trip(spark):
    texts = corpus()
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 5"))
    placed = packing.pack_documents(docs, capacities=(64, 128, 256)).cache()
    rows = placed.collect()
    words = {i: (t or "").split() for i, t in enumerate(texts)}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_words
    assert got == Counter({i: len(w) * (2 if i == 5 else 1) for i, w in words.items() if w})
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.slot)
        assert [r.offset for r in b] == list(itertools.accumulate([0, *[r.n_words for r in b]]))[:-1]
        assert sum(r.n_words for r in b) == b[0].used <= b[0].capacity
    made = {r.bin: r for r in packing.sequences(placed, docs).collect()}
    assert set(made) == set(bins)
    for name, b in bins.items():
        assert made[name].doc_ids == [r.doc_id for r in b]
        assert made[name].text == "\n".join(" ".join(words[r.doc_id][r.first_word : r.first_word + r.n_words]) for r in b)
    assert packing.pack_documents(table(spark, [None, ""])).count() == 0


LANGS = {"en": "the of and that with house river stone", "de": "der die und nicht haus fluss stein mit", "fr": "le la les des maison fleuve pierre avec"}


def sentence(lang, seed, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def test_languages(spark):
    docs = spark.createDataFrame([(i, sentence(lang, i), lang) for i, lang in enumerate(sorted(LANGS) * 20)], "doc_id long, text string, lang string")
    model = languages.text_model(docs)
    assert model[0] == sorted(LANGS)
    pages = [(i, f"https://www.h{lang}.{lang}/x", f'<html lang="{lang}"><head><title>x</title></head><body><p>{sentence(lang, 500 + i)}</p></body>') for i, lang in enumerate(sorted(LANGS) * 8)]
    pages += [(90, "https://www.hde.de/y", "<html><body>77</body>"), (91, None, None), (92, "nonsense", f"<p>{sentence('fr', 7)}</p>"), (93, "http://a.other/", '<html lang="de">1 2 3</html>')]
    rows = languages.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: r for r in languages.identify(rows, model, ["page_id"]).collect()}
    assert all(got[i].lang == lang for i, lang in enumerate(sorted(LANGS) * 8))
    assert got[90].lang == "de" and got[90].prior_lang == "de" and got[90].probability > 0.5
    assert got[91].lang is not None and got[92].lang == "fr" and got[93].lang == "de"
    own = languages.identify(languages.document_rows(table(spark, [sentence("de", 3), None, ""])), model, ["doc_id"], markup=False)
    assert {r.doc_id: r.lang for r in own.collect()}[0] == "de"
    assert languages.identify(rows.limit(0), model, ["page_id"]).count() == 0
    assert languages.identify(rows, languages.text_model(docs.limit(0)), ["page_id"]).where("lang is null").count() == len(pages)


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("substantial", "large").replace("copies", "copys", 1)
    texts = [prose(1, 50) + "\n" + mit + "\n" + prose(2, 50), changed, "Released under the MIT License. x\nReleased under the\nMIT License!", "the license of the software", None, "", prose(3, 2000)]
    got = {r.doc_id: [(n.license, round(n.coverage, 2), n.start, n.end) for n in r.notices] for r in licenses.scan_licenses(table(spark, texts)).collect()}
    at = texts[0].index("Permission")
    assert got[0] == [("MIT", 1.0, at, at + len(mit))]
    assert [x[0] for x in got[1]] == ["MIT"] and 0.95 < got[1][0][1] < 1
    assert [x[:3] for x in got[2]] == [("MIT-notice", 1.0, 0), ("MIT-notice", 1.0, 34)]
    assert all(got[i] == [] for i in (3, 4, 5, 6))
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_licenses_finds_every_copy():
    templates = {n: [w for w, _, _ in licenses.normal(t)] for n, t in licenses.TEMPLATES.items()}
    short, mit = licenses.TEMPLATES["Apache-2.0-notice"], licenses.TEMPLATES["MIT"]
    for text, copy, name in ((f"The notice: {short} Later again: {short} The end", short, "Apache-2.0-notice"), (f"{mit} and the license {mit}\n{mit}", mit, "MIT")):
        got = [(n["start"], n["end"], n["coverage"]) for n in licenses.find(text, templates) if n["license"] == name]
        starts = [m.start() for m in re.finditer(re.escape(copy), text)]
        assert [x[0] for x in got] == starts and all(c == 1 for _, _, c in got)
    # all starts and ends, by the plain recurrence
    rng = random.Random(8)
    seen = 0
    for _ in range(400):
        template = [rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))]
        words = [rng.choice("abcdefgxy") for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(4)):
            words += [w for w in template if rng.random() < 0.9] + [rng.choice("abcdefgxy") for _ in range(rng.randrange(4))]
        need, reach, begin, want = 0.8 * len(template), licenses.STRETCH * len(template), 0, 0
        for end in range(1, len(words) + 1):
            if any(common(words[a:end], template) >= need for a in range(max(begin, end - reach), end)):
                want, begin = want + 1, end
        got = licenses.find(" ".join(words), {"t": template}, 0.8)
        assert len(got) == want
        seen += want
        last = -1
        for n in got:
            a, b = n["start"] // 2, (n["end"] + 1) // 2
            assert a > last and b - a <= reach and common(words[a:b], template) == round(n["coverage"] * len(template)) >= need
            last = b - 1
    assert seen > 300


def test_alignment_is_common_and_rising():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_pieces_hold_whole_texts():
    from veilgrain.llm.arrays import pieces

    column = pa.array(["ab", None, "", "cdé", "x" * 50], pa.string())
    for part in (column, column.slice(1, 3)):
        seen = []
        for first, last, data, offsets in pieces(part, 4):
            seen += [bytes(data[a:b]).decode() for a, b in itertools.pairwise(offsets)]
            assert last - first == len(offsets) - 1
        assert seen == [x or "" for x in part.to_pylist()]


def test_types(spark):
    assert isinstance(ngram_join.near_groups(table(spark, ["a"])).schema["doc_id"].dataType, T.LongType)


def test_license_coverage_is_that_of_the_alignment(monkeypatch):
    templates = {n: [w for w, _, _ in licenses.normal(t)] for n, t in licenses.TEMPLATES.items()}
    words = licenses.TEMPLATES["MPL-2.0"].split()
    text = "before " + " ".join(w for i, w in enumerate(words) if i % 9 != 4) + " after"
    (found,) = (n for n in licenses.find(text, templates) if n["license"] == "MPL-2.0")
    kept = [w for w, _, _ in licenses.normal(text)]
    assert found["coverage"] == len(licenses.align(kept, templates["MPL-2.0"])) / len(templates["MPL-2.0"]) < 1
    monkeypatch.setattr(licenses, "align", lambda text, template: [])
    assert licenses.find(text, templates) == []
    a, b = "x p x q x r x".split(), "x q x r x p".split()
    monkeypatch.undo()
    assert all(a[i] == b[j] for i, j in licenses.align(a, b)) and len(licenses.align(a, b)) >= 4


def test_automata_keep_length_and_forgive(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    model = secrets.Automaton.learn(hexes)
    assert len(model.states) == 41
    fresh = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    assert model.log_likelihood(fresh) > model.log_likelihood(fresh[:39]) + 5
    assert model.log_likelihood(fresh) > model.log_likelihood(fresh + "0") + 5
    assert model.log_likelihood(fresh) > model.log_likelihood("g" + fresh[1:]) > model.log_likelihood("g" * 40)
    # merging against a plain prefix tree: the same counts leave and enter
    words = ["ab" * (1 + min(k for k in range(12) if k == 11 or rng.random() < 0.5)) for _ in range(800)]
    merged = secrets.Automaton(words, {})
    assert len(merged.states) < 6 < 2 * max(map(len, words)) and sum(merged.stop[s] for s in merged.states) == len(words)
    assert sum(merged.seen[s].total() for s in merged.states) == sum(map(len, words))


def test_bare_credentials_of_a_learned_format(spark, monkeypatch):
    rng = random.Random(6)
    pin = lambda: "x" + "".join(rng.choice("0123456789") for _ in range(7))
    token = lambda: "ghp_" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20))
    words = prose(3, 400).split()
    texts = [f"{prose(k, 30)} password: {pin()} then" for k in range(120)] + [f"{prose(k, 30)} token = {token()} then" for k in range(120)]
    bare = [pin(), token(), pin()]
    texts += [f"{prose(900 + k, 20)} {value} {prose(k, 9)}" for k, value in enumerate(bare)] + [" ".join(words)]
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(table(spark, texts)).collect()}
    for k, value in enumerate(bare):
        at = texts[240 + k].index(value)
        assert [(s.kind, s.start, s.end) for s in rows[240 + k]] == [("format", at, at + len(value))]
    assert rows[243] == []
    assert all(s.score is not None and s.score > 0 for k in range(240) for s in rows[k])


def test_items_of_one_id_do_not_add_up(spark):
    first, second = ("alder birch cedar dogwood elm fir gum hazel ironwood juniper kapok larch", "maple nutmeg oak pine quince rowan spruce teak ash bay cob dill")
    tests = spark.createDataFrame([(1, first), (1, second), (1, first)], "item_id long, text string")
    halves = " ".join(first.split()[:5]) + " filler words here " + " ".join(second.split()[:5])
    docs = table(spark, [halves, "x " * 40 + first + " y" * 40, second])
    got = sorted((r.doc_id, r.start, r.end, r.matched) for r in decontaminate.contaminated(docs, tests).collect())
    assert got == [(1, 40, 52, 12), (2, 0, 12, 12)]
