"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that they find.

The fixed patterns give the base spans. Their finds are the labelled credentials: a bounded sample of
distinct ones (``SAMPLE`` at most, those with the smallest hashes over all documents, none longer than ``LONGEST``)
builds one prefix tree per kind, over classes of characters, and states that are statistically compatible are merged (ALERGIA:
Hoeffding bounds on the share of each next class and of stops). Within a class all characters are as likely,
as in random credentials. What else occurs is told by the background: how often each character follows two
others, counted over all runs of credential characters in all documents (bounded by the characters, 70^3 counts).
Every run of ``LEAST_LENGTH`` (the shortest labelled length) or more credential characters in every text, less
what base spans cover of it and the dots at its ends, is a candidate. It is an added span if, by its likelihood
under the best automaton and under the background, and the share of credentials among all runs, it is
likelier a credential than not.

Defined cases: null and empty texts have no spans; very long texts are scanned whole; repeated rows get equal
results; texts without labelled credentials give no automata, which add nothing; an empty table gives no rows; further columns
are left alone.
"""

from collections import Counter
from collections.abc import Iterator
import functools
from math import log, sqrt
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drop_stored, stored

#: At most so many distinct labelled credentials of each kind, of so many characters at most, train the automata.
SAMPLE, LONGEST = 20_000, 4096
ALPHA = 0.05
#: Made-up counts by which the background is smoothed.
SMOOTH = 30

# The kinds in the order in which spans at one start are listed, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_ADDED = "inferred"
#: The fewest characters of a labelled credential (those of an assignment), and so of a candidate.
LEAST_LENGTH = 6

_RUN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]")
# Symbols of the background: the characters of runs, the start and the end of a run.
_ALPHABET = "^$+-./0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_N = len(_ALPHABET)
_CODE = np.zeros(256, np.int32)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(_N)
#: Characters of runs looked at together.
_TOGETHER = 1 << 18

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans in order of start, then kind. A run of hex digits is found whole."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def credential(text: str, span: Span) -> str:
    """The credential itself: of an assignment its value."""
    found = text[span[1] : span[2]]
    return _ASSIGN.match(found)[2] if span[0] == "assign" else found


# Classes of characters, and how many characters each has; all other characters are classes of their own.
_SIZES = {"9": 10, "f": 6, "z": 20, "A": 26}
_CLASSES = str.maketrans(dict.fromkeys("0123456789", "9") | dict.fromkeys("abcdef", "f") | dict.fromkeys("ghijklmnopqrstuvwxyz", "z") | dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"))


def classes(word: str) -> str:
    return word.translate(_CLASSES)


class Automaton:
    """A deterministic probabilistic automaton: counts of next classes and of stops by state."""

    def __init__(self, words: Counter[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.stop = [0]
        for word, n in words.items():
            at = 0
            for c in word:
                self.count[at][c] = self.count[at].get(c, 0) + n
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.stop.append(0)
                at = self.next[at][c]
            self.stop[at] += n

    def _total(self, s: int) -> int:
        return self.stop[s] + sum(self.count[s].values())

    def _alike(self, a: int, b: int) -> bool:
        """Hoeffding: no share of two states, nor of those that follow, differs by more than chance allows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            bound = sqrt(0.5 * log(2 / ALPHA)) * (1 / sqrt(n) + 1 / sqrt(m))
            if abs(self.stop[a] / n - self.stop[b] / m) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """The tree under b is added to the states under a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.stop[a] += self.stop[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def merged(self) -> "Automaton":
        """Red states are kept; each blue one, a child of a red, folds into the first red it is alike, or turns red."""
        red = [0]
        while True:
            known = set(red)
            blue = next(((r, c, to) for r in red for c, to in sorted(self.next[r].items()) if to not in known), None)
            if blue is None:
                return self
            parent, c, state = blue
            for r in red:
                if self._alike(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)

    @functools.cached_property
    def logs(self) -> list[tuple[dict[str, tuple[float, int]], float, float]]:
        """By state: log share and next state of each class, of an unseen class, and of a stop."""
        out = []
        for s in range(len(self.next)):
            n = self._total(s) + 11  # one made-up credential for each of ten classes and the stop
            out.append(({c: (log((k + 1) / n), self.next[s][c]) for c, k in self.count[s].items()}, log(1 / n), log((self.stop[s] + 1) / n)))
        return out

    @functools.cached_property
    def best(self) -> dict[str, float]:
        """The largest log share that each class has in any state; under "" that of an unseen one, and under "stop" of a stop."""
        out: dict[str, float] = {"": max(x[1] for x in self.logs), "stop": max(x[2] for x in self.logs)}
        for known, _, _ in self.logs:
            for c, (p, _) in known.items():
                out[c] = max(p, out.get(c, out[""]))
        return out

    def likelihood(self, word: str) -> float:
        """Log-likelihood of a word's classes. An unseen class costs the least share and leaves the state as it is."""
        at, total, logs = 0, 0.0, self.logs
        for c in word:
            known, unseen, _ = logs[at]
            step = known.get(c)
            if step is None:
                total += unseen
            else:
                total += step[0]
                at = step[1]
        return total + logs[at][2]


class Model:
    """What tells credentials from other runs. automata: by kind, with the kind's share of the labelled credentials;
    counts: of each three symbols in a row over all runs; prior: the share of credentials among all runs."""

    def __init__(self, automata: dict[str, tuple[Automaton, float]], counts: np.ndarray, prior: float):
        self.automata, self.prior = automata, prior
        # Counts of three are smoothed by those of the last two, these by equal shares.
        three = counts.reshape(_N, _N, _N).astype(np.float64)
        two = three.sum(axis=0)
        share2 = (two + SMOOTH / _N) / (two.sum(axis=1, keepdims=True) + SMOOTH)
        self.background = np.log((three + SMOOTH * share2) / (three.sum(axis=2, keepdims=True) + SMOOTH)).astype(np.float32).ravel()
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    @functools.cached_property
    def bounds(self) -> tuple[np.ndarray, float]:
        """By symbol: the most that a character adds to any automaton's log-likelihood; and the most that the stop adds."""
        every = [a for a, _ in self.automata.values()]
        of = {c: max(a.best.get(k := classes(c), a.best[""]) for a in every) - log(_SIZES.get(k, 1)) for c in _ALPHABET[2:]}
        return np.array([0.0, 0.0, *of.values()]), max(a.best["stop"] for a in every)

    def _credential(self, word: str) -> float:
        own = classes(word)
        return max(a.likelihood(own) + log(share) for a, share in self.automata.values()) - sum(log(_SIZES.get(c, 1)) for c in own)

    def scores(self, runs: list[str]) -> np.ndarray:
        """Log odds of each run being a credential. Where even the best states of all automata give less than 0, this bound stands for them."""
        if not runs or not self.automata:
            return np.full(len(runs), -np.inf)
        symbols, cells, ends = _symbols(runs)
        own = np.concatenate(([0.0], np.cumsum(np.where(symbols[2:] == 0, 0, self.background[cells]), dtype=np.float64)))
        begin = np.concatenate(([0], ends[:-1] + 1))
        other = own[ends - 1] - own[begin]
        by_symbol, stop = self.bounds
        most = np.concatenate(([0.0], np.cumsum(by_symbol[symbols])))
        odds = log(self.prior / (1 - self.prior))
        out = most[ends] - most[begin] + stop - other + odds
        for i in np.flatnonzero(out > 0).tolist():
            found = self.known.get(runs[i])
            if found is None:
                found = self._credential(runs[i])
                if len(runs[i]) <= 256:
                    if len(self.known) >= 100_000:
                        self.known.clear()
                    self.known[runs[i]] = found
            out[i] = found - other[i] + odds
        return out


def _symbols(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of runs one after the other, each with two starts before it and an end; the cell of each three in a row; where the ends are."""
    symbols = _CODE[np.frombuffer(("^^" + "$^^".join(runs) + "$").encode(), np.uint8)]
    return symbols, (symbols[:-2] * _N + symbols[1:-1]) * _N + symbols[2:], np.flatnonzero(symbols == 1)


def _pieces(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Start and end of each candidate: runs, or what base spans leave of them."""
    if not base:
        return [m.span() for m in _RUN.finditer(text)]
    out, at = [], 0
    for a, b in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
        if a > at:
            out += [m.span() for m in _RUN.finditer(text, at, a)]
        at = max(at, b)
    return out


def _grouped(texts: list[str | None]) -> Iterator[list[tuple[str, list[Span], list[str]]]]:
    """Some texts at a time, with their base spans and candidates."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        base = base_spans(text)
        runs = [text[a:b] for a, b in _pieces(text, base)] if base else _RUN.findall(text)
        held.append((text, base, runs))
        size += sum(map(len, runs))
        if size > _TOGETHER:
            yield held
            held, size = [], 0
    yield held


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, word, n: a task's distinct credentials; its counts of each three symbols, as kind ``three``; and of its runs, as kind ``runs``."""
    found, three, n_runs = Counter(), np.zeros(_N**3, np.int64), 0
    for batch in batches:
        for group in _grouped(batch.column(0).to_pylist()):
            runs = [r for _, _, own in group for r in own]
            n_runs += len(runs)
            if runs:
                symbols, cells, _ = _symbols(runs)
                three += np.bincount(cells[symbols[2:] != 0], minlength=_N**3)
            for text, base, _ in group:
                found.update((s[0], credential(text, s)) for s in base)
        if len(found) > SAMPLE:
            yield _counted(found)
            found.clear()
    cells = np.flatnonzero(three)
    words = [_ALPHABET[c // _N**2] + _ALPHABET[c // _N % _N] + _ALPHABET[c % _N] for c in cells.tolist()]
    yield _counted(found | Counter({("three", w): n for w, n in zip(words, three[cells].tolist(), strict=True)}) | Counter({("runs", ""): n_runs}))


def _counted(found: Counter) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "word", "n"])


def label(docs: DataFrame) -> DataFrame:
    """kind, word, n over all documents: labelled credentials by kind, counts of three symbols in a row, and of runs."""
    own = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_labelled, "kind string, word string, n long")
    return stored(own.groupBy("kind", "word").agg(F.sum("n").alias("n")), "labelled")


def fit(found: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from what ``label`` gives. To the driver come ``sample`` credentials of each kind at most, and 70^3 counts at most."""
    sums = {r["kind"]: r["s"] for r in found.groupBy("kind").agg(F.sum("n").alias("s")).collect()}
    total = sum(sums.get(k, 0) for k in KINDS)
    automata = {}
    for kind in KINDS:
        rows = found.filter((F.col("kind") == kind) & (F.length("word") <= LONGEST)).select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()
        if rows:
            automata[kind] = Automaton(Counter(classes(r["word"]) for r in rows)).merged(), sums[kind] / total
    counts = np.zeros(_N**3, np.int64)
    for r in found.filter("kind = 'three'").select("word", "n").toLocalIterator():
        a, b, c = (_ALPHABET.index(x) for x in r["word"])
        counts[(a * _N + b) * _N + c] = r["n"]
    return Model(automata, counts, (total + 1) / (total + sums.get("runs", 0) + 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    found = label(docs)
    out = fit(found, sample)
    drop_stored(found)
    return out


def added_spans(group: list[tuple[str, list[Span], list[str]]], model: Model) -> list[list[Span]]:
    """By text: the candidates that are likelier credentials than not."""
    score = model.scores([r for _, _, own in group for r in own])
    out, at = [], 0
    for text, base, runs in group:
        hit = np.flatnonzero(score[at : at + len(runs)] > 0)
        at += len(runs)
        if len(hit):
            where = _pieces(text, base)
            out.append([(_ADDED, *where[i]) for i in hit.tolist()])
        else:
            out.append([])
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(model: Model, of: int, redact: bool):
    kinds = (*KINDS, _ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, new = [], [], []
            texts = batch.column(of).to_pylist()
            for group in _grouped(texts):
                for (text, own, _), added in zip(group, added_spans(group, model), strict=True):
                    every = sorted(own + added, key=lambda s: (s[1], kinds.index(s[0])))
                    if redact:
                        new.append(redacted(text, every) if every else texts[len(new)])
                    else:
                        base.append(joined(own))
                        spans.append(joined(every))
            if redact:
                cols = list(batch.columns)
                cols[of] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:of], pa.array(base, pa.string()), pa.array(spans, pa.string())], names=[*batch.schema.names[:of], "base", "spans"])

    return run


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and spans: joined kind:start:end by code points, ends exclusive."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scan(model, 1, False), f"doc_id {kind}, base string, spans string")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with their secrets replaced in the text; other columns as they were."""
    return docs.mapInArrow(_scan(model, docs.columns.index("text"), True), docs.schema)
