"""Secret scan: format automata inferred from labelled credentials."""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bidframe.llm.common import cut, rows_of, texts

KINDS = ("assign", "access", "hex")
#: The fixed patterns of the base and the least length of each (of the value, for assign).
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_HINTS = ("passw", "secret", "token", "api")
#: A candidate is a run of 12 or more token characters with a digit, a sign or a capital
#: after a letter in it: anything but a plain word.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_TRIGGER = re.compile(r"[0-9+/_=]|(?<=[A-Za-z])[A-Z]")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
LEAST_CANDIDATE = 12

#: Scores are counted in steps of this width for the thresholds.
STEP = 2.0 ** -12
#: Test level of the merge test, and the share of ordinary tokens that may pass a threshold.
ALPHA, FALSE_RATE = 0.02, 1e-3

_CLASSES = np.full(128, 7, np.int8)
for _number, _chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF",
                                  "GHIJKLMNOPQRSTUVWXYZ", "+/=", "_-.")):
    for _char in _chars:
        _CLASSES[ord(_char)] = _number
#: Characters of each class; a class emits each of its characters alike.
_SIZES = np.array([10, 6, 20, 6, 20, 3, 3, 60], float)
END = 8


def symbols(value: str) -> np.ndarray:
    codes = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
    return _CLASSES[np.minimum(codes, 127)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base, by start and then kind as listed."""
    found, low = [], text.lower()
    if any(hint in low for hint in _HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end()))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST["access"]:
            found.append((m.start(), 1, m.end()))
    # A run too short for the least length holds no other match, so only long ones are looked for.
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of all candidates, without signs at their ends."""
    found, done = [], 0
    m = _TRIGGER.search(text)
    while m:
        start = m.start()
        while start > done and text[start - 1] in _TOKEN:
            start -= 1
        done = _RUN.match(text, start).end()
        value = text[start:done]
        left = len(value) - len(value.lstrip("+/_.=-"))
        value = value.strip("+/_.=-")
        if len(value) >= LEAST_CANDIDATE:
            found.append((start + left, start + left + len(value)))
        m = _TRIGGER.search(text, done)
    return found


@dataclass(frozen=True)
class Automaton:
    """Deterministic: ``step[state, symbol]`` is the next state (-1: none), ``cost`` its log probability."""

    step: np.ndarray
    cost: np.ndarray

    def log_likelihood(self, path: np.ndarray) -> float:
        """Of a class path and its end; a step never seen costs the floor and restarts."""
        state, total = 0, 0.0
        for s in path:
            total += self.cost[state, s]
            state = max(int(self.step[state, s]), 0)
        return total + float(self.cost[state, END])


def infer(samples: list[np.ndarray], alpha: float = ALPHA) -> Automaton:
    found = Counter("".join(map(str, path)) for path in samples)
    return merged(list(found), list(found.values()), alpha)


def merged(paths: list[str], times: list[int], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the whole prefix tree of the class paths, in breadth-first order.

    Two states are compatible if for every symbol and the end their shares differ by less than a Hoeffding bound
    at level ``alpha``, so do the states they lead to, and so do the shares of values with at most any number of
    characters left. Merging adds the counts and merges what both lead to. The tree is never laid out: below the
    states found so far stand the places where the paths leave them, and a merged subtree is its paths read on
    from the state it joins. So every path counts to its end, and memory is the paths and a place for each.
    """
    text = np.frombuffer("".join(p + str(END) for p in paths).encode(), np.uint8) - ord("0")
    last = np.flatnonzero(text == END)
    weight, width = np.asarray(times, float), len(text) + 1
    bound = np.sqrt(0.5 * np.log(2 / alpha))
    few = bound ** 2  # shares differ by 1 at most: as few values as this differ from nothing
    step, counts = np.full((0, 8), -1), np.zeros((0, 9))
    left: list[Counter] = []
    fringe: dict[tuple[int, int], list] = {}

    def enter(who: np.ndarray, at: np.ndarray, state: int) -> None:
        """Read paths ``who`` from their places ``at`` on, from ``state`` to their end or out of the known states."""
        state = np.full(len(who), state)
        while len(who):
            symbol = text[at]
            np.add.at(counts, (state, symbol), weight[who])
            keys, same = np.unique(state * width + last[who] - at, return_inverse=True)
            for k, n in zip(keys.tolist(), np.bincount(same, weight[who]).tolist()):
                left[k // width][k % width] += n
            on = symbol != END
            who, at, state, symbol = who[on], at[on] + 1, state[on], symbol[on]
            new = step[state, symbol]
            edges = state * 8 + symbol
            for edge in np.unique(edges[new < 0]).tolist():
                out = edges == edge
                fringe.setdefault(divmod(edge, 8), []).append((who[out], at[out]))
            who, at, state = who[new >= 0], at[new >= 0], new[new >= 0]

    def places(edge: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        fringe[edge] = [tuple(map(np.concatenate, zip(*fringe[edge])))]
        return fringe[edge][0]

    def ends_alike(a: Counter, b: Counter) -> bool:
        lengths = sorted(a.keys() | b.keys())
        x, y = (np.cumsum([c[k] for k in lengths]) for c in (a, b))
        return np.abs(x / x[-1] - y / y[-1]).max() < bound * (x[-1] ** -0.5 + y[-1] ** -0.5)

    def alike(r: int, who: np.ndarray, at: np.ndarray, rest: Counter) -> bool:
        """Whether state ``r`` and the subtree of the places agree; a level of pairs of states at a time."""
        if not ends_alike(left[r], rest):
            return False
        # Each pair is a known state, or places of its own (own_*), against places of the subtree.
        known, pair = np.array([r]), np.zeros(len(who), int)
        own, own_at, own_pair = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
        while len(known):
            size = len(known)
            b = np.bincount(pair * 9 + text[at], weight[who], size * 9).reshape(size, 9)
            a = np.bincount(own_pair * 9 + text[own_at], weight[own], size * 9).reshape(size, 9)
            a[known >= 0] = counts[known[known >= 0]]
            na, nb = a.sum(1), b.sum(1)
            both = (na > 0) & (nb > 0)
            na, nb = np.maximum(na, 1)[:, None], np.maximum(nb, 1)[:, None]
            if (np.abs(a / na - b / nb) >= bound * (na ** -0.5 + nb ** -0.5))[both].any():
                return False
            loops = (known >= 0)[:, None] & (step[known] >= 0)  # states reached there may have more values
            on = (b[:, :8] > few) & ((a[:, :8] > few) | loops) & both[:, None]
            number = np.full((size, 9), -1)
            number[:, :8][on] = np.arange(on.sum())
            parents, symbols_ = np.nonzero(on)
            new = np.where(known[parents] >= 0, step[known[parents], symbols_], -1)
            stay = number[pair, text[at]]
            who, at, pair = who[stay >= 0], at[stay >= 0] + 1, stay[stay >= 0]
            stay = np.where(known[own_pair] < 0, number[own_pair, text[own_at]], -1)
            parts = [(own[stay >= 0], own_at[stay >= 0] + 1, stay[stay >= 0])]
            for i in np.flatnonzero((known[parents] >= 0) & (new < 0)).tolist():
                more = places((int(known[parents[i]]), int(symbols_[i])))
                parts.append((*more, np.full(len(more[0]), i)))
            own, own_at, own_pair = map(np.concatenate, zip(*parts))
            known = new
        return True

    def add() -> int:
        nonlocal step, counts
        step, counts = np.vstack([step, np.full((1, 8), -1)]), np.vstack([counts, np.zeros((1, 9))])
        left.append(Counter())
        return len(left) - 1

    enter(np.arange(len(last)), np.concatenate([[0], last[:-1] + 1])[:len(last)], add())
    while fringe:
        edge = min(fringe)
        who, at = places(edge)
        lengths, same = np.unique(last[who] - at, return_inverse=True)
        rest = Counter(dict(zip(lengths.tolist(), np.bincount(same, weight[who]).tolist())))
        to = next((r for r in range(len(left)) if alike(r, who, at, rest)), None)
        to = add() if to is None else to
        step[edge] = to
        del fringe[edge]
        enter(who, at, to)
    share = (counts + 1e-4) / (counts.sum(1, keepdims=True) + 9e-4)
    cost = np.log(share)
    cost[:, :8] -= np.log(_SIZES)
    return Automaton(np.hstack([step, np.full((len(step), 1), -1)]), cost)


@dataclass(frozen=True)
class Scanner:
    """One automaton for each credential format, one for ordinary tokens, and the thresholds."""

    formats: dict[str, Automaton]
    ordinary: Automaton | None
    thresholds: dict[str, float]
    #: Values of each kind, and ordinary tokens, that were learnt from.
    seen: dict[str, int] = field(default_factory=dict)

    def likelihood(self, value: str) -> dict[str, float]:
        """Log likelihood ratio to ordinary tokens, by character, for each format."""
        path = symbols(value)
        plain = self.ordinary.log_likelihood(path)
        return {k: (a.log_likelihood(path) - plain) / (len(path) + 1) for k, a in self.formats.items()}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Base spans and the candidates that pass; a candidate that meets a base span is dropped."""
        base = base_spans(text)
        if self.ordinary is None or not self.formats:
            return base
        added, at = [], 0
        inside = sorted((s, e) for _, s, e in base)
        for start, end in candidates(text):
            while at < len(inside) and inside[at][1] <= start and inside[at][0] < start:
                at += 1
            if any(s < end and start < e for s, e in inside[max(at - 2, 0): at + 3]):
                continue
            scores = self.likelihood(text[start:end])
            best = max(scores, key=scores.get)
            if scores[best] > self.thresholds[best]:
                added.append((best, start, end))
        return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if added else base


def _labelled(batches):
    """The values of each kind, and the tokens outside of all spans; once for each batch."""
    for batch in batches:
        found = {k: set() for k in (*KINDS, "ordinary")}
        for text in texts(batch):
            spans = base_spans(text)
            for kind, s, e in spans:
                found[kind].add(ASSIGN.match(text, s)[1] if kind == "assign" else text[s:e])
            for s, e in candidates(text):
                if not any(a < e and s < b for _, a, b in spans):
                    found["ordinary"].add(text[s:e])
        rows = [(k, v) for k, values in found.items() for v in sorted(values)]
        yield rows_of({"kind": (pa.string(), [r[0] for r in rows]), "value": (pa.string(), [r[1] for r in rows])})


def _paths(batches):
    """The values of a batch as class paths."""
    for batch in batches:
        paths = ["".join(map(str, symbols(v))) for v in batch.column(1).to_pylist()]
        yield rows_of({"kind": (pa.string(), batch.column(0)), "path": (pa.string(), paths)})


def _scored(scanner: Scanner):
    """Steps that the scores of the values fall in: an ordinary token has one for each format, others for their own."""

    def run(batches):
        for batch in batches:
            rows = Counter()
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if kind != "ordinary" and kind not in scanner.formats:
                    continue
                for k, score in scanner.likelihood(value).items():
                    if kind in (k, "ordinary"):
                        rows[k, kind == "ordinary", int(np.floor(score / STEP))] += 1
            rows = [(*key, n) for key, n in rows.items()]
            yield rows_of({name: (t, [r[i] for r in rows]) for i, (name, t) in enumerate(
                (("kind", pa.string()), ("plain", pa.bool_()), ("step", pa.int64()), ("n", pa.int64())))})

    return run


def _quantile(steps: list[tuple[int, int]], share: float) -> int:
    """The step that the value at this share of all falls in."""
    steps = sorted(steps)
    total = np.cumsum([n for _, n in steps])
    return steps[min(int(np.searchsorted(total, share * total[-1])), len(steps) - 1)][0]


def train(docs: DataFrame, text_col: str = "text") -> Scanner:
    """Infer an automaton for each kind from all its distinct values.

    The base patterns label the credentials of the whole table; candidates outside of their
    spans are the ordinary tokens. Values are turned into class paths and counted by path and by score step
    on the cluster; the driver holds each distinct path once. Every third value is kept for the thresholds: above all
    but the share ``FALSE_RATE`` of the ordinary tokens and not below the weakest hundredth
    of the kind's own values. Kinds with fewer than 30 values get no automaton: for these
    only the base speaks.
    """
    values = cut(docs.select(F.col(text_col).alias("text")).mapInArrow(_labelled, "kind string, value string")
                 .distinct().withColumn("test", F.pmod(F.xxhash64("value"), F.lit(3)) == 0))
    seen = {r.kind: r.n for r in values.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = [k for k in KINDS if seen.get(k, 0) >= 30]
    if not kinds or seen.get("ordinary", 0) < 30:
        return Scanner({}, None, {}, seen)
    counted = (values.where("NOT test").select("kind", "value").mapInArrow(_paths, "kind string, path string")
               .groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n")).toArrow())
    found: dict[str, Automaton] = {}
    for k in (*kinds, "ordinary"):
        # In an order of their own: however the rows were dealt out, sums are made alike.
        own = counted.filter(pc.equal(counted["kind"], k)).sort_by("path")
        found[k] = merged(own["path"].to_pylist(), own["n"].to_pylist())
    scanner = Scanner({k: found[k] for k in kinds}, found["ordinary"], {}, seen)
    scored = (values.where("test").select("kind", "value")
              .mapInArrow(_scored(scanner), "kind string, plain boolean, step bigint, n bigint")
              .groupBy("kind", "plain", "step").agg(F.sum("n").alias("n")))
    steps: dict[tuple, list] = {}
    for row in scored.collect():
        steps.setdefault((row.kind, row.plain), []).append((row.step, row.n))
    for k in kinds:
        plain = (_quantile(steps[k, True], 1 - FALSE_RATE) + 1) * STEP if (k, True) in steps else 0.0
        own = _quantile(steps[k, False], 0.01) * STEP if (k, False) in steps else 0.0
        scanner.thresholds[k] = max(plain, own, 0.0)
    return scanner


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``base``, ``spans``): arrays of (kind, start, end), a row for each of ``docs``.

    Offsets are code points, ends exclusive. Whole texts are read, null as empty; repeated
    rows and null ids stay; extra columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]

    def run(batches):
        for batch in batches:
            base, spans = [], []
            for text in texts(batch, 1):
                base.append(as_rows(base_spans(text)))
                spans.append(as_rows(scanner.spans(text)))
            yield rows_of({"doc_id": (batch.schema.field(0).type, batch.column(0)),
                           "base": (span, base), "spans": (span, spans)})

    kinds = "array<struct<kind: string, start: bigint, end: bigint>>"
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, base {kinds}, spans {kinds}"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
