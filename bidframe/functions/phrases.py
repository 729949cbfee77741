"""Scores of many short texts against a fixed phrase list, a column of texts at a time.

Same measure as ``similarity._phrase_ratio``: the best of the whole ratio, the token-set
ratio and 0.96 of the best window ratio (phrases of four characters or more). Here each
phrase meets all texts at once: the bit-parallel LCS keeps one machine word per text or per
window and takes one array step per character.
"""
from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BITS = 63


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as a padded matrix of small codes (0: none) and their lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint32)
    for i, text in enumerate(texts):
        out[i, :len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def _masks(phrase: str, alphabet: np.ndarray) -> np.ndarray:
    """Bit mask of the phrase's places for each letter of the alphabet."""
    found = np.zeros(len(alphabet), np.uint64)
    for i, ch in enumerate(phrase):
        at = np.searchsorted(alphabet, ord(ch))
        if at < len(alphabet) and alphabet[at] == ord(ch):
            found[at] |= np.uint64(1 << i)
    return found


def _step(row: np.ndarray, hit: np.ndarray) -> np.ndarray:
    hit = row & hit
    return (row + hit) | (row - hit)


def _common(row: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common subsequence: bits of the word that fell to 0."""
    full = np.uint64((1 << bits) - 1)
    return bits - np.bitwise_count(row & full).astype(np.int64)


class Texts:
    """Texts whose characters are numbered by a common alphabet (0: padding)."""

    def __init__(self, texts: list[str]):
        raw, self.lengths = _codes(texts)
        self.alphabet = np.unique(raw) if raw.size else np.zeros(1, np.uint32)
        if self.alphabet[:1].tolist() != [0]:
            self.alphabet = np.concatenate([np.zeros(1, np.uint32), self.alphabet])
        self.codes = np.searchsorted(self.alphabet, raw)
        self.n = len(texts)

    def lcs(self, phrase: str) -> np.ndarray:
        masks = _masks(phrase, self.alphabet)
        masks[0] = 0
        row = np.full(self.n, (1 << len(phrase)) - 1, np.uint64)
        for k in range(self.codes.shape[1]):
            row = _step(row, masks[self.codes[:, k]])
        return _common(row, len(phrase))

    def windows(self, phrase: str) -> np.ndarray:
        """Best ratio of the phrase to windows of its length in each text at least as long."""
        n, width = len(phrase), self.codes.shape[1]
        masks = _masks(phrase, self.alphabet)
        masks[0] = 0
        hits = np.zeros((self.n, width + 2 * n - 1), np.uint64)
        hits[:, n - 1:n - 1 + width] = masks[self.codes]
        places = width + n - 1
        row = np.full((self.n, places), (1 << n) - 1, np.uint64)
        for k in range(n):
            row = _step(row, hits[:, k:k + places])
        start = np.arange(places) - (n - 1)
        held = np.minimum(start + n, self.lengths[:, None]) - np.maximum(start, 0)
        total = n + held
        ratio = 100.0 - 100.0 * (total - 2 * _common(row, n)) / np.maximum(total, 1)
        return np.where(held > 0, ratio, 0.0).max(axis=1, initial=0.0)


def _within(texts: list[str], phrases: list[str]) -> np.ndarray:
    """Best ratio of texts of one length to windows of that length in the phrases, all as long at least."""
    m, held = len(texts[0]), Texts(texts)
    pieces = [[p[max(s, 0):s + m] for s in range(1 - m, len(p))] for p in phrases]
    raw, sizes = _codes([w for some in pieces for w in some])
    at = np.minimum(np.searchsorted(held.alphabet, raw), len(held.alphabet) - 1)
    codes = np.where((held.alphabet[at] == raw) & (raw > 0), at, 0)
    starts = np.cumsum([0, *map(len, pieces[:-1])])
    own = np.zeros((len(texts), len(held.alphabet)), np.uint64)
    for k in range(m):
        np.bitwise_or.at(own, (np.arange(len(texts)), held.codes[:, k]), np.uint64(1 << k))
    own[:, 0] = 0
    best = np.zeros((len(texts), len(phrases)))
    total = m + sizes
    for rows in np.array_split(np.arange(len(texts)), len(texts) * len(codes) // 1_000_000 + 1):
        row = np.full((len(rows), len(codes)), (1 << m) - 1, np.uint64)
        for k in range(m):
            row = _step(row, own[rows[:, None], codes[None, :, k]])
        ratio = 100.0 - 100.0 * (total - 2 * _common(row, m)) / total
        best[rows] = np.maximum.reduceat(ratio, starts, axis=1)
    return best


def scores(texts: list[str], phrases: list[str], one) -> np.ndarray:
    """Texts x phrases. ``one`` measures the few pairs that share a token or are too long for a word."""
    out = np.zeros((len(texts), len(phrases)))
    if not texts:
        return out
    tokens = [frozenset(t.split()) for t in texts]
    by_token: dict[str, list[int]] = {}
    for i, words in enumerate(tokens):
        for word in words:
            by_token.setdefault(word, []).append(i)
    sorted_texts = Texts([" ".join(sorted(w)) for w in tokens])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # Texts of like length share a matrix, so one long text pads only its own group.
    groups = [(rows, Texts([texts[i] for i in rows])) for k in np.unique(lengths // 16)
              for rows in [np.flatnonzero(lengths // 16 == k)]]
    for j, phrase in enumerate(phrases):
        n = len(phrase)
        if n > WORD_BITS:
            out[:, j] = [one(t, phrase) for t in texts]
            continue
        words = set(phrase.split())
        lined = " ".join(sorted(words))
        size = np.maximum(sorted_texts.lengths + len(lined), 1)
        out[:, j] = 100.0 - 100.0 * (size - 2 * sorted_texts.lcs(lined)) / size
        for rows, part in groups:
            total = np.maximum(part.lengths + n, 1)
            best = 100.0 - 100.0 * (total - 2 * part.lcs(phrase)) / total
            if n >= 4:
                if (long := part.lengths >= n).any():
                    best = np.where(long, np.maximum(best, 0.96 * part.windows(phrase)), best)
            out[rows, j] = np.maximum(out[rows, j], best)
    for m in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == m)
        able = [j for j, p in enumerate(phrases) if max(m, 4) <= len(p) <= WORD_BITS]
        if able:
            best = _within([texts[i] for i in rows], [phrases[j] for j in able])
            out[np.ix_(rows, able)] = np.maximum(out[np.ix_(rows, able)], 0.96 * best)
    for j, phrase in enumerate(phrases):
        for i in {i for word in set(phrase.split()) for i in by_token.get(word, ())}:
            out[i, j] = one(texts[i], phrase)
    return out
