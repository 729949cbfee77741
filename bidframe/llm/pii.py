"""Personal data: overlapping candidates, boosted trees on format and context, calibrated thresholds."""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from bidframe.llm.common import rows_of, texts

KINDS = ("email", "ip", "card", "phone")
#: Fixed base patterns; the e-mail address is found from its ``@`` outwards.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a run of digits: its beginning would have matched before.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators of high recall: looser forms of each kind, spelled-out or spaced.
LOOSE = {
    "email": re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}"
                        r"(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20./-][0-9]{2,6}){2,4})(?![0-9])"),
    "phone": re.compile(r"(?:\+\x20?|00)?\(?[0-9]{1,4}\)?(?:[\x20()./-]{1,3}[0-9]{2,5}){1,5}(?![0-9])"),
}
_HINTS = {"email": ("@", "(at)", "[at]", " at "), "ip": (".",)}
_AT, _DOT = re.compile(r"\s?(?:\(at\)|\[at\]|\sat\s)\s?"), re.compile(r"\s?(?:\(dot\)|\[dot\]|\sdot\s|\[\.\]|\(\.\))\s?")
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|send", re.I), "ip": re.compile(r"\bip|host|server|addr|login", re.I),
    "card": re.compile(r"card|visa|master|credit|pay|iban", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax|cell", re.I),
}
FEATURES = ("digits", "length", "groups", "longest_group", "luhn", "octets", "plus", "brackets", "signs", "blanks",
            "at", "dots", "last_part", "first_part", "letters", "spelled", "before_word", "after_word", "keyword",
            "other_keyword", "line_start", "digits_near")
#: Most documents whose candidates the trees learn from; candidates kept of each; trees, their depth and rate.
SAMPLE_DOCS, SAMPLE_CANDIDATES, TREES, DEPTH, RATE = 20_000, 16, 40, 3, 0.2
#: Precision that candidates above a threshold must have on the calibration third.
PRECISION = 0.99


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, done := m.end()))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base, by kind as listed and then start."""
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of all generators."""
    low, found = text.lower(), []
    for kind, pattern in LOOSE.items():
        if kind not in _HINTS or any(h in low for h in _HINTS[kind]):
            if kind == "email":
                found += _loose_emails(text, low)
            else:
                found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return found


def _loose_emails(text: str, low: str) -> list[tuple[str, int, int]]:
    """The loose address around each sign for ``@``, sought in the 70 characters before it."""
    found, done = [], 0
    for sign in re.finditer(r"@|\(at\)|\[at\]|\sat\s", low):
        # Signs like `` at `` are common words: only a spelled-out dot soon after makes one.
        if sign[0] != "@" and not re.search(r"\(dot\)|\[dot\]|\sdot\s|[a-z0-9]\.[a-z]{2,}", low[sign.end():sign.end() + 80]):
            continue
        start = max(done, sign.start() - 70)
        for m in LOOSE["email"].finditer(text, start, min(len(text), sign.end() + 330)):
            if m.start() < sign.end() <= m.end():
                found.append(("email", m.start(), m.end()))
                done = m.end()
                break
    return found


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    raw = text[start:end]
    value = _DOT.sub(".", _AT.sub("@", raw))
    groups = re.findall(r"[0-9]+", value)
    digits = "".join(groups)
    parts = re.split(r"[.@]", value)
    before, after = text[max(0, start - 40):start], text[end:end + 20]
    near = before + " " + after
    return [float(x) for x in (
        len(digits), len(value), len(groups), max(map(len, groups), default=0), len(digits) > 12 and luhn(digits),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), value.startswith("+"),
        value.count("("), len(re.findall(r"[./-]", value)), value.count(" "), value.count("@"), value.count("."),
        len(parts[-1]), len(parts[0]), sum(map(str.isalpha, value)), value != raw,
        before[-1:].isalnum(), after[:1].isalnum(), bool(_CONTEXT[kind].search(near)),
        any(p.search(near) for k, p in _CONTEXT.items() if k != kind), not before or before[-1:] == "\n",
        sum(map(str.isdigit, near)))]


@dataclass(frozen=True)
class Trees:
    """Boosted oblivious trees: each level of a tree asks one question of all its nodes."""

    questions: np.ndarray  # (trees, depth, 2): feature, limit
    leaves: np.ndarray  # (trees, 2 ** depth)
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for ask, leaf in zip(self.questions, self.leaves):
            at = np.zeros(len(x), int)
            for feature, limit in ask:
                at = 2 * at + (x[:, int(feature)] > limit)
            out += leaf[at]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss; every level takes the question of the largest gain."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    raw, asks, leaves = np.full(len(y), start), [], []
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[:-1])) for j in range(x.shape[1])]
    questions = [(j, t) for j, ts in enumerate(limits) for t in ts]
    answers = np.array([x[:, j] > t for j, t in questions])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        at, ask = np.zeros(len(y), int), []
        for level in range(DEPTH):
            best, gain = 0, -1.0
            size = 2 ** (level + 1)
            for q, answer in enumerate(answers):
                to = 2 * at + answer
                g, h = np.bincount(to, grad, size), np.bincount(to, curve, size)
                if (now := float((g * g / (h + 1)).sum())) > gain + 1e-12:
                    best, gain = q, now
            ask.append(questions[best])
            at = 2 * at + answers[best]
        size = 2 ** DEPTH
        leaf = RATE * np.bincount(at, grad, size) / (np.bincount(at, curve, size) + 1)
        asks.append(ask), leaves.append(leaf)
        raw = raw + leaf[at]
    return Trees(np.array(asks, float), np.array(leaves), start)


@dataclass(frozen=True)
class Finder:
    """Trees and threshold of each kind; a kind without trees has its base only."""

    trees: dict[str, Trees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Base spans, which stay, and the best-scored candidates that pass and meet no other span."""
        base = base_spans(text)
        if not self.trees:
            return base
        taken = sorted((s, e) for _, s, e in base)
        free = [c for c in proposals(text) if c[0] in self.trees and not _meets(taken, c[1], c[2])]
        passed = []
        for kind in self.trees:
            own = [c for c in free if c[0] == kind]
            if own:
                scores = self.trees[kind].raw(np.array([describe(text, *c) for c in own]))
                passed += [(-s, c) for s, c in zip(scores, own) if s > self.thresholds[kind]]
        added: list[tuple[str, int, int]] = []
        for _, (kind, s, e) in sorted(passed):
            if not _meets(sorted((a, b) for _, a, b in added), s, e):
                added.append((kind, s, e))
        return sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if added else base


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    import bisect

    at = bisect.bisect_left(spans, (end, -1))
    return any(e > start for _, e in spans[max(0, at - 4):at])


def _spell(kind: str, value: str, turn: int) -> str:
    """A base span written as people do to hide it, for a positive example outside of the base."""
    if kind == "email":
        at, dot = ((" (at) ", "."), ("@", " dot "), (" at ", " dot "), ("[at]", "[dot]"))[turn % 4]
        return value.replace("@", at).replace(".", dot)
    if kind == "ip":
        return value.replace(".", ("[.]", " . ", "(.)")[turn % 3])
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", value)
        sign = ("/", ".")[turn % 2]
        return sign.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return value.replace("+", ("00", "+ ")[turn % 2], 1)


def _spoil(kind: str, value: str, turn: int) -> str:
    """A base span made invalid, for a negative example close to the kind's format."""
    if kind == "email":
        return ("@" + value.partition("@")[2], value.replace(".", ""), value.partition("@")[0] + "@2.0.1")[turn % 3]
    if kind == "ip":
        first, _, rest = value.partition(".")
        return (f"{300 + turn % 600}.{rest}", f"v{value}", f"{first}.{turn % 10}")[turn % 3]
    if kind == "card":
        return value[:-1] + str((int(value[-1]) + 1 + turn % 9) % 10)
    return (value[1:8], value.replace("+", "no. ", 1)[:12], value + "." + value[1:])[turn % 3]


def _examples(batches):
    """Candidates with their label: a valid span as it is or spelled otherwise, or an overlap with none."""
    for batch in batches:
        kinds, label, rank, rows = [], [], [], []
        for text in texts(batch):
            base = base_spans(text)
            spans = sorted((s, e) for _, s, e in base)
            chosen = [c for c in proposals(text) if not _meets(spans, c[1], c[2])]
            pick = lambda c: xxhash.xxh64_intdigest(f"{c[1]}|{text[c[1]:c[2]]}")
            for kind, s, e in sorted(base, key=pick)[:SAMPLE_CANDIDATES]:
                turn = pick((kind, s, e))
                rows.append(describe(text, kind, s, e))
                for value in (_spell(kind, text[s:e], turn), _spoil(kind, text[s:e], turn)):
                    changed = text[max(0, s - 60):s] + value + text[e:e + 60]
                    rows.append(describe(changed, kind, min(s, 60), min(s, 60) + len(value)))
                kinds += [kind] * 3
                label += [1, 1, 0]
                rank += [(turn * k >> 1) % (1 << 62) for k in (1, 31, 37)]
            for c in sorted(chosen, key=pick)[:SAMPLE_CANDIDATES]:
                rows.append(describe(text, *c))
                kinds.append(c[0]), label.append(0), rank.append(pick(c) >> 1)
        yield rows_of({"kind": (pa.string(), kinds), "label": (pa.int32(), label), "rank": (pa.int64(), rank),
                       "x": (pa.list_(pa.float64()), rows)})


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, most: int = 6_000) -> Finder:
    """Learn from the candidates of at most ``sample_docs`` documents, first in hash order of the text.

    There are no labels for personal data, so the base patterns give them: a candidate at a
    valid base span is personal data, also when spelled otherwise (``_spell``); one that
    meets no valid span, or is a valid one made invalid (``_spoil``), is not. At most ``most`` candidates of a kind and label are used.
    Every third one is kept to calibrate: the threshold is the lowest score above which the
    share of personal data is ``PRECISION`` or more and at least one in 200 others fails.
    A kind with fewer than 30 examples of either label has its base only.
    """
    some = (docs.select(F.col(text_col).alias("text")).where("text is not null")
            .withColumn("_h", F.xxhash64("text")))
    # The documents of smallest hash, found by the hash alone.
    limit = some.select("_h").orderBy("_h").limit(sample_docs).agg(F.max("_h")).first()[0]
    if limit is None:
        return Finder()
    examples = (some.where(F.col("_h") <= limit).select("text")
                .mapInArrow(_examples, "kind string, label int, rank bigint, x array<double>"))
    place = Window.partitionBy("kind", "label").orderBy("rank", "x")
    rows = examples.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).collect()
    trees, thresholds = {}, {}
    for kind in KINDS:
        own = sorted((r.label, r.n, r.x) for r in rows if r.kind == kind)
        x, y = np.array([r[2] for r in own]), np.array([r[0] for r in own])
        if min((y == 1).sum(), (y == 0).sum()) < 30:
            continue
        test = np.arange(len(y)) % 3 == 0
        model = boost(x[~test], y[~test].astype(float))
        score, truth = model.raw(x[test]), y[test]
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        ends = np.append(score[order][1:] < score[order][:-1], True)
        good = np.flatnonzero(ends & (right >= PRECISION))
        if len(good):
            negatives = score[truth == 0]
            k = good[-1]
            below = score[order[k + 1]] if k + 1 < len(order) else score[order[k]] - 1
            trees[kind] = model
            thresholds[kind] = max(float((score[order[k]] + below) / 2), float(np.quantile(negatives, 0.995)))
    return Finder(trees, thresholds)


def find(docs: DataFrame, finder: Finder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
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
                spans.append(as_rows(finder.spans(text)))
            yield rows_of({"doc_id": (batch.schema.field(0).type, batch.column(0)),
                           "base": (span, base), "spans": (span, spans)})

    kinds = "array<struct<kind: string, start: bigint, end: bigint>>"
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, base {kinds}, spans {kinds}"))


def redact(docs: DataFrame, finder: Finder, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind, as in ``[EMAIL]``; overlapping spans become one.

    ``length_col``, where there is such a column, gets the new length of changed texts; all
    other columns and rows stay as they are.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def mask(text: str | None) -> str | None:
        spans = sorted((s, e, k) for k, s, e in finder.spans(text)) if text else []
        out, done = [], 0
        for s, e, kind in spans:
            if s >= done:
                out += [text[done:s], f"[{kind.upper()}]"]
            done = max(done, e)
        return "".join([*out, text[done:]]) if spans else text

    def run(batches):
        for batch in batches:
            columns, old = list(batch.columns), batch.column(at)
            new = [mask(t.as_py()) for t in old]
            columns[at] = pa.array(new, old.type)
            if length is not None:
                kept = columns[length]
                columns[length] = pa.array([n.as_py() if t is None or t == o.as_py() else len(t)
                                            for n, t, o in zip(kept, new, old)], kept.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
