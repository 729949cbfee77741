"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bidframe.llm.common import rows_of, texts

#: Length of a q-gram; characters of a pattern and the step to the next; edits allowed per character.
Q, WINDOW, STEP, EDIT_RATE = 10, 64, 32, 0.08
#: Characters of all patterns of one block: what a task holds of the benchmark at once.
BLOCK_CHARS = 2_000_000
#: Texts of a slice are handled together up to about so many characters.
SLICE_CHARS = 400_000

#: Between texts: a code point that is kept, more often than any region has edits.
SENTINEL = "\U0010ffff" * 2 * Q

_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case letter or digit of each code point up to 2FFF; 0: left out."""
    out = np.zeros(0x3000, np.uint32)
    for c in range(0x3000):
        if chr(c).isalnum():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits of a text and where each stands; blanks and signs don't count."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    low = np.where(codes < 0x3000, table[np.minimum(codes, 0x2FFF)], codes)
    at = np.flatnonzero(low)
    return low[at], at


def qgrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams, built by doubling."""
    h, width, out, done = codes.astype(np.uint64), 1, None, 0
    with np.errstate(over="ignore"):
        h = (h + np.uint64(1)) * _P
        need = Q
        while need:
            if need & 1:
                piece = h[done:]
                out = piece if out is None else out[:len(piece)] * _P ** np.uint64(width) + piece[:len(out)]
                done += width
            need >>= 1
            if need:
                h = h[:-width] * _P ** np.uint64(width) + h[width:] if len(h) > width else h[:0]
                width *= 2
        out = out[:max(0, len(codes) - Q + 1)]
        return out ^ (out >> np.uint64(31))


@dataclass
class Index:
    """Patterns of a block of the benchmark and where their q-grams stand."""

    items: list
    starts: np.ndarray
    codes: list[np.ndarray]
    budgets: np.ndarray
    needs: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    bits: np.ndarray

    @property
    def least(self) -> int:
        return int(self.needs.min()) if len(self.needs) else 1

    @property
    def widest(self) -> int:
        return max((len(c) + e for c, e in zip(self.codes, self.budgets)), default=1)


def budget(length: int) -> int:
    """Edits allowed: at the rate, but few enough that the lemma still asks for a shared q-gram."""
    return max(0, min(int(EDIT_RATE * length), (length - Q) // Q))


def index(patterns: list[tuple[object, int, np.ndarray]]) -> Index:
    """A pattern of n letters within e edits shares at least n - q + 1 - q * e q-grams with its region."""
    n = np.array([len(c) for _, _, c in patterns], int)
    e = np.array([budget(x) for x in n], int)
    grams = [qgrams(c) for _, _, c in patterns]
    hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
    owner = np.repeat(np.arange(len(patterns)), [len(g) for g in grams])
    place = np.concatenate([np.zeros(0, int), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(hashes, kind="stable")
    bits = np.zeros(1 << 22, bool)
    bits[(hashes & np.uint64((1 << 22) - 1)).astype(int)] = True
    return Index([p[0] for p in patterns], np.array([p[1] for p in patterns], int), [p[2] for p in patterns], e,
                 np.maximum(n - Q + 1 - Q * e, 1), hashes[order], owner[order], place[order], bits)


def windows(text: str) -> list[tuple[int, np.ndarray]]:
    """(first letter, letters) of the patterns of an item: overlapping windows, or the whole of a short one."""
    codes, _ = letters(text)
    if len(codes) < Q:
        return []
    if len(codes) <= WINDOW + STEP // 2:
        return [(0, codes)]
    starts = [*range(0, len(codes) - WINDOW, STEP), len(codes) - WINDOW]
    return [(s, codes[s:s + WINDOW]) for s in starts]


def _candidates(ix: Index, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pattern, least diagonal of the band) of the bands with enough shared q-grams."""
    h = qgrams(codes)
    hit = np.flatnonzero(ix.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
    if not len(hit):
        return
    # First by place alone: enough hits must lie within the widest region.
    count = np.searchsorted(hit, hit + ix.widest) - np.arange(len(hit))
    dense = np.zeros(len(hit) + 1, int)
    good = np.flatnonzero(count >= ix.least)
    np.add.at(dense, good, 1)
    np.add.at(dense, good + count[good], -1)
    hit = hit[np.cumsum(dense[:-1]) > 0]
    if not len(hit):
        return
    low, high = np.searchsorted(ix.hashes, h[hit]), np.searchsorted(ix.hashes, h[hit], "right")
    for part in np.array_split(np.arange(len(hit)), max(1, int((high - low).sum()) // 4_000_000 + 1)):
        # A piece ends where no region can reach over, so a band is counted in one piece.
        n = (high - low)[part]
        rows = np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield ix.owner[rows], np.repeat(hit[part], n) - ix.place[rows]


def _regions(ix: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and middle diagonals of the regions that meet the lemma.

    Bands of 2 * width diagonals overlap by half, with the width above the edit budget, so
    all shared q-grams of a region lie in one band at least.
    """
    found = list(_candidates(ix, codes))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    owner, diagonal = (np.concatenate(x) for x in zip(*found))
    width = int(ix.budgets.max(initial=0)) + 1
    shift = WINDOW + STEP
    keys = []
    for half in (0, 1):
        band = (diagonal + shift - half * width) // (2 * width)
        key = owner * (len(codes) // width + shift) + band
        values, counts = np.unique(key, return_counts=True)
        own, b = values // (len(codes) // width + shift), values % (len(codes) // width + shift)
        enough = counts >= ix.needs[own]
        keys.append((own[enough], b[enough] * 2 * width + half * width - shift + width))
    return tuple(np.concatenate(x) for x in zip(*keys))


def align(pattern: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the pattern anywhere in the text, or None above the budget.

    Rows run over the pattern; the start is free, the end is the best. Each row is one pass
    of array operations, with the horizontal gaps taken as a running minimum.
    """
    m = len(text)
    steps = np.arange(m + 1)
    cost, start = np.zeros(m + 1, int), steps.copy()
    big = m + len(pattern) + 2
    for i, c in enumerate(pattern):
        diagonal, above = cost[:-1] + (text != c), cost + 1
        new, origin = above.copy(), start.copy()
        better = diagonal < new[1:]
        new[1:][better] = diagonal[better]
        origin[1:][better] = start[:-1][better]
        # Gaps along the text: least of (cost - place) so far, plus place.
        lead = (new - steps) * big + steps
        low = np.minimum.accumulate(lead)
        source = low % big
        gap = low // big + steps
        take = gap < new
        new[take], origin[take] = gap[take], origin[source[take]]
        cost, start = new, origin
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= budget else None


def matches(ix: Index, some: list[str]) -> list[list[tuple[object, int, int, int, int]]]:
    """For each text its (item, first letter of the pattern, start, end, edits), in code points.

    The texts are looked through as one, with more sentinels between them than a region may
    have edits.
    """
    out: list[dict] = [{} for _ in some]
    codes, at = letters(SENTINEL.join(some))
    starts = np.cumsum([0, *(len(t) + len(SENTINEL) for t in some[:-1])])
    width = int(ix.budgets.max(initial=0)) + 1
    for p, d in zip(*(x.tolist() for x in _regions(ix, codes))):
        pattern, e = ix.codes[p], int(ix.budgets[p])
        low, high = max(0, d - width - e), min(len(codes), d + len(pattern) + width + e)
        found = align(pattern, codes[low:high], e)
        if found and found[2] > found[1]:
            edits, s, t = found
            first, last = at[low + s].item(), at[low + t - 1].item() + 1
            doc = int(np.searchsorted(starts, first, "right")) - 1
            key, row = (ix.items[p], int(ix.starts[p])), (edits, first - int(starts[doc]), last - int(starts[doc]))
            out[doc][key] = min(out[doc].get(key, row), row)
    return [[(item, k, s, t, edits) for (item, k), (edits, s, t) in found.items()] for found in out]


def _grouped(values: Iterator[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``SLICE_CHARS`` characters; a longer text is a list of its own."""
    some, size = [], 0
    for text in values:
        if some and size + len(text) > SLICE_CHARS:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's patterns, brought to the driver in blocks of bounded size."""
    patterns, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).distinct().toLocalIterator():
        for start, codes in windows(r.t or ""):
            patterns.append((r.i, start, codes))
            size += len(codes)
            if size >= BLOCK_CHARS:
                yield index(patterns)
                patterns, size = [], 0
    if patterns:
        yield index(patterns)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Regions of ``docs`` that hold a passage of ``benchmark``: a row for each (document, item).

    Columns: ``doc_id``, ``item_id``, ``windows`` (patterns of the item found), ``start`` and
    ``end`` (code points from the first to the last of them), ``edits`` (least of one
    pattern). Compared are letters and digits in lower case. An item is cut into
    overlapping patterns of ``WINDOW`` letters (a short item is one pattern), each found
    within ``EDIT_RATE`` edits per letter, wherever it stands. Items with fewer than ``Q``
    letters, null and empty ones have no pattern; null and empty texts hold none.

    The documents are read once for each block of ``BLOCK_CHARS`` letters of the benchmark,
    and only the block goes to the tasks. Null ids stay null; repeated rows give repeated
    results only once for an id; extra columns are not read.
    """
    columns = "doc_id bigint, item_id bigint, pattern bigint, start bigint, end bigint, edits bigint"
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = own.sparkSession.createDataFrame([], columns)
    for ix in _blocks(benchmark, item_id_col, item_text_col):
        held = own.sparkSession.sparkContext.broadcast(ix)

        def run(batches, held=held):
            for batch in batches:
                found = (m for some in _grouped(texts(batch, 1)) for m in matches(held.value, some))
                out = [(doc.as_py(), *m) for doc, each in zip(batch.column(0), found) for m in each]
                names = [c.split()[0] for c in columns.split(", ")]
                yield rows_of({c: (pa.int64(), [r[i] for r in out]) for i, c in enumerate(names)})

        found = found.union(own.mapInArrow(run, columns))
    return (found.groupBy("doc_id", "item_id")
            .agg(F.count_distinct("pattern").alias("windows"), F.min("start").alias("start"),
                 F.max("end").alias("end"), F.min("edits").alias("edits")))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                        item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a passage; every column stays as it is."""
    at = docs.columns.index(text_col)
    for ix in _blocks(benchmark, item_id_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches, held=held):
            for batch in batches:
                clean = [not m for some in _grouped(texts(batch, at)) for m in matches(held.value, some)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
