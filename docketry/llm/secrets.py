"""Secret scans: fixed patterns, and formats learned from what the patterns find."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from statistics import NormalDist, pstdev
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LEAST_VALUE = 8
#: A shorter run fails its length, and no shorter part of it could pass: so lengths go in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs of these are candidates, and so is every part of a run that begins behind one of the cuts
#: and ends at or behind one: a value may have cuts of its own, as base64 and dotted formats do.
CANDIDATE, CUT = r"[A-Za-z0-9+/_.=-]", re.compile(r"[=/.]")

#: Labelled credentials of one kind that an automaton is inferred from, and the longest of them.
MAX_LABELLED, MAX_LENGTH = 600, 128
#: Fewer make no format: a length, a letter class and an end cannot be told from chance.
LEAST_LABELLED = 4
#: Confidence of the state merging test; less merges more.
ALPHA = 0.05
#: A state whose letters are one and the same in so large a share of so many visits stands for that letter.
LITERAL, LEAST_VISITS = 0.9, 8
#: Every so many labelled credentials one is kept back to set the bounds; all serve if there are no more.
KEEP_BACK = 4
#: Share of credentials like those kept back that may score beyond either bound.
EDGE = 0.005
#: A candidate may score so much less or more per symbol than the bounds.
SLACK = 0.02
#: How much likelier (natural logarithm) a candidate must be as a credential than as ordinary text.
MARGIN = 12.0
#: Strings whose verdict a task remembers; bounds memory.
REMEMBERED = 1 << 16
REDACTED = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the fixed patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


#: Letter classes; marks of candidates are classes of their own, and so is all other text.
_CLASSES = {c: k for k, cs in {"0": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in cs} | {c: c for c in "+/_.=-"}
_NAMES = ["0", "a", "g", "A", "G", *"+/_.=-", " "]
_NUMBER = np.array([_NAMES.index(_CLASSES.get(chr(b), " ")) for b in range(256)], dtype=np.uint8)


class State:
    """Visits by what came next: a letter or digit ("x"), a mark, or the end (""); letters also by class and as they are."""

    def __init__(self) -> None:
        self.next: dict[str, int] = {}
        self.steps, self.classes, self.letters = Counter(), Counter(), Counter()

    def add(self, other: State) -> None:
        self.steps.update(other.steps)
        self.classes.update(other.classes)
        self.letters.update(other.letters)

    def differs(self, other: State) -> bool:
        """Hoeffding's test on the shares of steps, of letter classes, and of either state's usual letter."""
        n, m = sum(self.steps.values()), sum(other.steps.values())
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        usual = {c for state in (self, other) for c, _ in state.letters.most_common(1)}
        shares = [(self.steps, other.steps, self.steps.keys() | other.steps.keys()), (self.classes, other.classes, self.classes.keys() | other.classes.keys()), (self.letters, other.letters, usual)]
        return any(abs(a[k] / n - b[k] / m) > bound for a, b, keys in shares for k in keys)


class Automaton:
    """A probabilistic automaton: the prefix tree of strings with compatible states merged.

    The tree branches by letters as such, marks and ends, so that states keep the visits that a test
    needs; what letters a state sees it counts by itself. Two states are compatible if neither they
    nor any states that follow them by the same steps differ.
    """

    def __init__(self, strings: list[str]) -> None:
        self.states = [State()]
        for s in strings:
            at = 0
            for c in s:
                state, step = self.states[at], "x" if c.isalnum() else c
                state.steps[step] += 1
                if step == "x":
                    state.classes[_CLASSES[c]] += 1
                    state.letters[c] += 1
                if step not in state.next:
                    state.next[step] = len(self.states)
                    self.states.append(State())
                at = state.next[step]
            self.states[at].steps[""] += 1
        self.kept = self._merge_states()
        self.odds = {at: self._odds(self.states[at]) for at in self.kept}

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            x, y = self.states[a], self.states[b]
            if x.differs(y):
                return False
            pairs += [(x.next[c], y.next[c]) for c in x.next.keys() & y.next.keys() if x.next[c] != y.next[c]]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree under blue to red."""
        work = [(red, blue)]
        while work:
            r, b = work.pop()
            self.states[r].add(self.states[b])
            for c, t in self.states[b].next.items():
                if c in self.states[r].next:
                    work.append((self.states[r].next[c], t))
                else:
                    self.states[r].next[c] = t

    def _merge_states(self) -> list[int]:
        """The states that are left: each was compared with all before it and is compatible with none."""
        red, seen = [0], {0}
        while True:
            blue = [(r, c, t) for r in red for c, t in sorted(self.states[r].next.items()) if t not in seen]
            if not blue:
                return red
            parent, c, state = min(blue, key=lambda x: (-sum(self.states[x[2]].steps.values()), x))
            for r in red:
                if self._compatible(r, state):
                    self.states[parent].next[c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                seen.add(state)

    @staticmethod
    def _odds(state: State) -> dict[str, tuple[float, int]]:
        """Character -> log likelihood and the state after it; "" is the end."""
        n, x = sum(state.steps.values()), state.steps["x"]
        out = {c: (math.log(k / n), state.next.get(c, -1)) for c, k in state.steps.items() if c != "x" and k}
        if x:
            usual = state.letters.most_common(1)[0][1]
            literal = x >= LEAST_VISITS and usual >= LITERAL * x
            for c, k in _CLASSES.items():
                if c.isalnum():
                    share = (state.letters[c] + 1e-3) / (x + 1e-2) if literal else (state.classes[k] + 1e-2) / (x + 5e-2)
                    out[c] = math.log(x / n * share), state.next["x"]
        return out

    def score(self, s: str) -> float:
        """Mean log likelihood of a symbol, the end counted as one; minus infinity for what cannot be."""
        at, total = 0, 0.0
        for c in s:
            step = self.odds[at].get(c)
            if step is None:
                return -math.inf
            total += step[0]
            at = step[1]
        end = self.odds[at].get("")
        return (total + end[0]) / (len(s) + 1) if end else -math.inf


class Background:
    """Ordinary text: how likely a letter class or mark follows another, counted over all documents."""

    def __init__(self, counts: dict[int, int]) -> None:
        n = len(_NAMES)
        table = np.full((n, n), 0.5)
        for pair, k in counts.items():
            table[divmod(pair, n)] += k
        table = np.log(table / table.sum(axis=1, keepdims=True))
        self.step = {(a, b): float(table[i, j]) for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES)}

    def log_likelihood(self, string: str) -> float:
        classes = [" ", *(_CLASSES[c] for c in string), " "]
        return sum(self.step[pair] for pair in zip(classes, classes[1:], strict=False))


def class_pairs(texts: list[str | None]) -> np.ndarray:
    """How often each class follows each in the texts, by number."""
    octets = np.frombuffer("\n".join(t for t in texts if t).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    numbers = _NUMBER[octets].astype(np.int64)
    return np.bincount(numbers[:-1] * len(_NAMES) + numbers[1:], minlength=len(_NAMES) ** 2)


class Format(NamedTuple):
    """An automaton, and the lengths and scores of the labelled credentials that are its own.

    Strings that are far likelier than any credential, such as digits alone where the format has
    hex digits, are as foreign to it as unlikely ones; so are those that ordinary text may hold.
    """

    automaton: Automaton
    shortest: int
    longest: int
    least: float
    most: float
    background: Background | None

    def score(self, string: str) -> float:
        """The string's mean log likelihood, minus infinity if it is none of the format's."""
        if not self.shortest <= len(string) <= self.longest:
            return -math.inf
        score = self.automaton.score(string)
        if not self.least <= score <= self.most:
            return -math.inf
        if self.background and score * (len(string) + 1) - self.background.log_likelihood(string) < MARGIN:
            return -math.inf
        return score


def quantile(values: list[float], share: float) -> float:
    """The quantile of values smoothed by a normal kernel, so that few values reach beyond their extremes."""
    wide = 1.06 * pstdev(values) * len(values) ** -0.2
    if not wide:
        return values[0]
    kernel = NormalDist(0, wide)
    low, high = min(values) - 9 * wide, max(values) + 9 * wide
    for _ in range(60):
        middle = (low + high) / 2
        if sum(kernel.cdf(middle - v) for v in values) < share * len(values):
            low = middle
        else:
            high = middle
    return high


def infer(labelled: dict[str, list[str]], background: Background | None = None) -> list[Format]:
    """A format for each kind with enough labelled credentials."""
    out = []
    for kind in sorted(labelled):
        values = [v for v in labelled[kind] if len(v) <= MAX_LENGTH]
        if len(values) < LEAST_LABELLED:
            continue
        back, learn = values[::KEEP_BACK], [v for i, v in enumerate(values) if i % KEEP_BACK]
        if len(back) < KEEP_BACK:
            back = learn = values
        automaton = Automaton(learn)
        scores = [x for x in map(automaton.score, back) if x > -math.inf]
        if scores:
            lengths = [len(v) for v in values]
            out.append(Format(automaton, min(lengths), max(lengths), quantile(scores, EDGE) - SLACK, quantile(scores, 1 - EDGE) + SLACK, background))
    return out


def parts(text: str, start: int, end: int, shortest: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a run and of its parts between cuts, of the lengths given."""
    cuts = [m.start() for m in CUT.finditer(text, start, end)]
    ends = sorted({end, *cuts, *(c + 1 for c in cuts)})
    for s in (start, *(c + 1 for c in cuts)):
        for e in ends[bisect_left(ends, s + shortest):bisect_right(ends, s + longest)]:
            yield s, e


def format_spans(text: str, taken: list[tuple[int, int, int, str]], formats: list[Format], known: dict[str, float] | None = None) -> list[tuple[int, int, int, str]]:
    """Candidates outside the spans taken that a format holds; of those that overlap the longest.

    What is left of a run that a span takes part of is a run. known remembers scores by string.
    """
    if not formats:
        return []
    known = {} if known is None else known
    shortest, longest = min(f.shortest for f in formats), max(f.longest for f in formats)
    run = re.compile(f"{CANDIDATE}{{{shortest},}}")
    held, at = [], 0
    for s, e in [*sorted((s, e) for s, _, e, _ in taken), (len(text), len(text))]:
        for m in run.finditer(text, at, s) if at < s else ():
            for a, b in parts(text, m.start(), m.end(), shortest, longest):
                string = text[a:b]
                if string not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[string] = max(f.score(string) for f in formats)
                if known[string] > -math.inf:
                    held.append((a, b))
        at = max(at, e)
    found = []
    for a, b in sorted(held, key=lambda x: (x[0] - x[1], x[0])):
        i = bisect_left(found, (a, 3, b, ""))
        if (i == 0 or found[i - 1][2] <= a) and (i == len(found) or found[i][0] >= b):
            found.insert(i, (a, 3, b, text[a:b]))
    return found


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled credentials of each batch, and at its end the task's pairs of classes."""
    common.only("secrets")
    pairs = np.zeros(len(_NAMES) ** 2, dtype=np.int64)

    def rows(kinds, values, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], ["kind", "value", "n"])

    for batch in batches:
        texts = batch.column("text").to_pylist()
        pairs += class_pairs(texts)
        found = Counter((KINDS[k], v) for text in texts if text for _, k, _, v in base_spans(text))
        yield rows([k for k, _ in found], [v for _, v in found], list(found.values()))
    seen = np.flatnonzero(pairs)
    yield rows(["pair"] * len(seen), [str(i) for i in seen], pairs[seen])


def learn(docs: DataFrame) -> list[Format]:
    """Formats from the credentials that the fixed patterns find in all of docs.

    Of each kind the MAX_LABELLED distinct values with the least hash are learned from, if they have
    MAX_LENGTH characters at most. The background counts all texts.
    """
    common.ship(docs.sparkSession)
    found = docs.select("text").mapInArrow(_labelled, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    found = common.stash(found, "labelled")
    labelled = defaultdict(list)
    for kind in KINDS[:3]:
        for row in found.filter((F.col("kind") == kind) & (F.length("value") <= MAX_LENGTH)).orderBy(F.xxhash64("value"), "value").limit(MAX_LABELLED).collect():
            labelled[kind].append(row.value)
    counts = {int(r.value): r.n for r in found.filter("kind = 'pair'").collect()}  # of a fixed number of pairs
    common.release(found)
    return infer(labelled, Background(counts))


def written(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


_DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, best_score double"


def _digests(formats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("secrets")
        known = {}
        for batch in batches:
            rows = []
            for text in (t.as_py() for t in batch.column("text")):
                base = base_spans(text or "")
                more = format_spans(text or "", base, formats, known)
                n = Counter(k for _, k, _, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more), max((known[v] for *_, v in more), default=None)))
            names = [c.split()[0] for c in _DIGEST.split(", ")]
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of secrets in every whole text of docs.

    Spans of the fixed patterns always stay; the learned formats add spans outside of them, and
    best_score is the highest mean log likelihood of those (null without any). Null
    and empty texts have none. Rows with null or repeated doc_ids are rows of their own. Only
    doc_id and text are read. An empty table, or one without labelled credentials, learns nothing.
    """
    formats = learn(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(formats), _DIGEST)


def redact(text: str, formats: list[Format], known: dict[str, bool] | None = None) -> str:
    base = base_spans(text)
    out, at = [], 0
    for s, _, e, _ in sorted(base + format_spans(text, base, formats, known)):
        if s >= at:
            out += [text[at:s], REDACTED]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def without_secrets(docs: DataFrame) -> DataFrame:
    """All rows of docs; in the texts every secret is replaced by REDACTED. n_chars follows, if there.

    Null texts stay null; nulls, repeated rows, empty tables and other columns are as for scan().
    """
    formats = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("secrets")
        known = {}
        for batch in batches:
            texts = [None if t is None else redact(t, formats, known) for t in (x.as_py() for x in batch.column("text"))]
            at = batch.schema.get_field_index("text")
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in batch.schema.names:
                n = batch.schema.get_field_index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
