"""Secrets in texts: fixed patterns, and formats inferred from the credentials that these find.

The values that the patterns find are labelled examples. For each kind a prefix tree
of their character classes is built and states whose futures agree statistically are
merged (the Hoeffding bound of ALERGIA), which leaves a probabilistic automaton; each
class has its own character frequencies. Which classes there are is decided by the
likelihood of examples held back, so that hex digits become one class where they are,
and states of little weight are not merged, so that an automaton keeps lengths that its
examples have. A model of one state, fitted on tokens that no pattern marks, is the
background. Every token from the shortest example's length on, and every value that a
pattern finds, is scored by how much likelier, per character, an automaton is to write it
than the background.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.session import written

#: What each kind matches and how long its value must be.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % min(LEAST.values()))
SIGNS = 66
SAMPLE = 4000
#: States lighter than this are not compared: chance would merge them with anything.
LEAST_WEIGHT = 16
#: Scores of tokens kept in a task.
MEMO = 1 << 17


def _classes(*groups: str) -> dict[str, str]:
    return {ch: group[0] for group in groups for ch in group}


_DIGITS, _AF, _GZ = "0123456789", "abcdef", "ghijklmnopqrstuvwxyz"
#: Character classes to choose from; a sign outside of them is a class of its own.
ALPHABETS = (
    _classes(_DIGITS, _AF, _GZ, _AF.upper(), _GZ.upper()),
    _classes(_DIGITS + _AF, _GZ, _AF.upper(), _GZ.upper()),
    _classes(_DIGITS + _AF.upper(), _GZ.upper(), _AF + _GZ),
    _classes(_DIGITS + _AF.upper() + _GZ.upper(), _AF + _GZ),
    _classes(_DIGITS, _AF + _GZ, _AF.upper() + _GZ.upper()),
    _classes(_DIGITS + _AF + _GZ + _AF.upper() + _GZ.upper()),
)
_KEY = re.compile("passw|secret|token|key", re.I)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns, by start and then kind; code points."""
    found = []
    if _KEY.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= LEAST["assign"]:
                found.append((m.start(), m.end(), "assign", m[1]))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


class Automaton:
    """States with counts of what follows; built as a prefix tree, then merged."""

    def __init__(self, words: list[str], classes: dict[str, str] = ALPHABETS[0], alpha: float = 0.05):
        self.classes = classes
        self.shortest = min(map(len, words), default=0)
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]
        self.stop: list[int] = [0]
        letters: dict[str, Counter] = {}
        for word in words:
            state = 0
            for ch in word:
                c = classes.get(ch, ch)
                letters.setdefault(c, Counter())[ch] += 1
                self.seen[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(Counter())
                    self.stop.append(0)
                state = self.next[state][c]
            self.stop[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.merge()
        size = Counter(classes.values())
        self.letters = {}
        for c, t in letters.items():
            whole = t.total() + 0.5 * max(size[c], 1)
            self.letters[c] = {ch: math.log((t[ch] + 0.5) / whole) for ch in [x for x, y in classes.items() if y == c] or [c]}
        self.steps = [self._odds(state) for state in range(len(self.next))]

    @classmethod
    def learn(cls, words: list[str]) -> Automaton:
        """With the classes under which a fifth of the words, held back, is likeliest."""
        late = words[::5]
        early = [w for i, w in enumerate(words) if i % 5]
        if not early:
            return cls(words)
        fitted = ((sum(map(cls(early, classes).log_likelihood, late)), -i) for i, classes in enumerate(ALPHABETS))
        return cls(words, ALPHABETS[-max(fitted)[1]])

    def _odds(self, state: int) -> tuple[dict[str, float], float, float, int]:
        """Log odds of each class, of a class not seen here and of the end, and where an unseen class leads: the usual way."""
        n = self.weight(state) + 0.01 * (SIGNS + 1)
        known = {c: math.log((count + 0.01) / n) for c, count in self.seen[state].items() if count}
        usual = max(self.seen[state].items(), key=lambda x: (x[1], x[0]), default=(None, 0))[0]
        return known, math.log(0.01 / n), math.log((self.stop[state] + 0.01) / n), self.next[state].get(usual, state)

    def weight(self, state: int) -> int:
        return self.seen[state].total() + self.stop[state]

    def agree(self, a: int, b: int) -> bool:
        """Whether two states, and those reached from them, differ by no more than chance."""
        work = [(a, b)]
        while work:
            a, b = work.pop()
            na, nb = self.weight(a), self.weight(b)
            slack = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.stop[a] / na - self.stop[b] / nb) > slack:
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a][c] / na - self.seen[b][c] / nb) > slack:
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    work.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, into: int, state: int) -> None:
        """Add the counts of a tree that hangs at ``state`` to the automaton at ``into``."""
        work = [(into, state)]
        while work:
            a, b = work.pop()
            self.stop[a] += self.stop[b]
            self.seen[a].update(self.seen[b])
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    work.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def merge(self) -> None:
        """Red states are settled; the heaviest successor of one joins a red state it agrees with, or becomes red."""
        red = [0]
        while True:
            known = set(red)
            blue = [(self.weight(to), r, c, to) for r in red for c, to in self.next[r].items() if to not in known]
            if not blue or max(blue)[0] < LEAST_WEIGHT:
                break
            _, r, c, to = max(blue)
            for q in red:
                if self.agree(q, to):
                    self.next[r][c] = q
                    self.fold(q, to)
                    break
            else:
                red.append(to)
        self.states = red

    def log_likelihood(self, word: str) -> float:
        """Of the whole token, its end included; what was never seen has the odds of a hundredth of a sample."""
        state, total = 0, 0.0
        for ch in word:
            c = self.classes.get(ch, ch)
            known, unseen, _, usual = self.steps[state]
            total += known.get(c, unseen) + self.letters.get(c, {}).get(ch, _UNSEEN)
            state = self.next[state][c] if c in known else usual
        return total + self.steps[state][2]


_UNSEEN = -math.log(SIGNS)


class Background:
    """One state: character frequencies and the mean length of unmarked tokens."""

    def __init__(self, words: list[str]):
        count = Counter("".join(words))
        size = count.total() + SIGNS
        self.odds = {ch: math.log((count[ch] + 1) / size) for ch in map(chr, range(128))}
        self.end = math.log(1 / (1 + (sum(map(len, words)) / len(words) if words else 24)))

    def log_likelihood(self, word: str) -> float:
        return sum(self.odds[ch] for ch in word) + self.end


SPAN = "struct<kind:string,start:long,end:long,score:double>"
OUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
EXAMPLE = pa.schema([("kind", pa.string()), ("value", pa.string())])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str]]:
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        yield doc_id.as_py(), text.as_py() or ""


def _tokens(text: str, marked: list[tuple]) -> Iterator[re.Match]:
    """Tokens that touch no marked span."""
    covered = [(a, b) for a, b, _, _ in marked]
    for m in TOKEN.finditer(text):
        if not covered or not any(a < m.end() and m.start() < b for a, b in covered):
            yield m


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = set()
        for _, text in _texts(batch):
            marked = base_spans(text)
            rows.update((kind, value) for _, _, kind, value in marked)
            rows.update(("other", m[0]) for m in _tokens(text, marked))
        kinds, values = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], schema=EXAMPLE)


def _mark(automata: dict[str, Automaton], background: Background, threshold: float):
    least = min((a.shortest for a in automata.values()), default=math.inf)

    def score(word: str, kinds) -> float | None:
        """Nats a character by which the likeliest of these automata beats the background."""
        best = max((automata[k].log_likelihood(word) for k in kinds if k in automata), default=None)
        return None if best is None else (best - background.log_likelihood(word)) / (len(word) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float | None] = {}
        for batch in batches:
            ids, spans = [], []
            for doc_id, text in _texts(batch):
                marked = base_spans(text)
                found = [{"kind": k, "start": a, "end": b, "score": score(v, (k,))} for a, b, k, v in marked]
                for m in _tokens(text, marked):
                    word = m[0]
                    if len(word) < least:
                        continue
                    if word not in memo:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[word] = score(word, KINDS)
                    value = memo[word]
                    if value is not None and value >= threshold:
                        found.append({"kind": "format", "start": m.start(), "end": m.end(), "score": value})
                found.sort(key=lambda x: (x["start"], (*KINDS, "format").index(x["kind"])))
                ids.append(doc_id)
                spans.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, OUT.field(1).type)], schema=OUT)

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans) for each row; ``spans`` is an array of (kind, start, end, score) by start, then kind.

    Kinds are assign, access, hex (fixed patterns, the value scored by the automaton of
    its kind) and format (a token that an automaton writes likelier than the background
    by ``threshold`` nats a character). The automata learn from the ``sample`` distinct values of each kind with the
    least hashes; all texts are searched for values, and all are scored. A null or empty text has no spans; with no
    values there are no automata and no format spans.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    examples = written(rows.mapInArrow(_examples, "kind string, value string").distinct(), "examples")
    chosen: dict[str, list[str]] = {}
    for kind in (*KINDS, "other"):
        ranked = examples.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
        chosen[kind] = [r.value for r in ranked.select("value").collect()]
    automata = {kind: Automaton.learn(chosen[kind]) for kind in KINDS if chosen[kind]}
    return rows.mapInArrow(_mark(automata, Background(chosen["other"]), threshold), f"doc_id long, spans array<{SPAN}>")
