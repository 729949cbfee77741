"""Text similarity by built-in expressions; ratios are 100 * (1 - (|a| + |b| - 2 LCS) / (|a| + |b|)).

The longest common subsequence is bit-parallel (Allison-Dix 1986, Hyyro 2004): one bit for each
character of the shorter text, one aggregate step for each of the longer. Up to 62 characters fit
a word; longer texts take several words with a carry. The noncharacter U+FFFF must not occur.
"""
from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Workers that score headers get the small helpers below with the task, whether or not they can import us.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BITS = 62
_FULL = (1 << WORD_BITS) - 1
_MARK = "\uffff"


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence (Allison-Dix 1986, Hyyro 2004)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 100.0 - 100.0 * (total - 2 * lcs_length(a, b)) / total


def _best_window(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0 if long else 100.0
    tries = [(short, long), (long, short)] if n == len(long) else [(short, long)]
    return max(_ratio(s, t[max(start, 0):start + n])
               for s, t in tries for start in range(1 - n, len(t)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _masks(text: Column) -> Column:
    """Character to the bits of its places; the first character has the highest bit."""
    def bits(c: Column) -> Column:
        marked = F.regexp_replace(F.replace(text, c, F.lit(_MARK)), f"[^{_MARK}]", "0")
        return F.conv(F.replace(marked, F.lit(_MARK), F.lit("1")), 2, 10).cast("bigint")

    return _let(F.array_distinct(_chars(text)), lambda cs: F.map_from_arrays(cs, F.transform(cs, bits)))


def _found(masks: Column, chars: Column) -> Column:
    return _let(masks, lambda held: F.transform(
        chars, lambda c: F.coalesce(F.element_at(held, c), F.lit(0).cast("bigint"))))


def _ones(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1


def _matched(masks: Column, n: Column) -> Column:
    """LCS with a text of ``n`` <= WORD_BITS characters, from the masks of the other's characters, last first."""
    def step(v: Column, m: Column) -> Column:
        return ((v + v.bitwiseAND(m)).bitwiseOR(v - v.bitwiseAND(m))).bitwiseAND(_ones(n))

    return n - F.bit_count(F.aggregate(masks, _ones(n), step))


def _lcs_word(short: Column, long: Column) -> Column:
    return _matched(_found(_masks(short), _chars(F.reverse(long))), F.length(short))


def _lcs_words(short: Column, long: Column) -> Column:
    """The same over several words; the sum of one word carries into the next."""
    n = F.length(short)
    last = F.ceil(n / WORD_BITS).cast("int") - 1
    # Word w holds the characters that end w words before the end of the text.
    stop = lambda w: n - w * WORD_BITS
    size = lambda w: F.least(stop(w), F.lit(WORD_BITS))
    piece = lambda w: F.substring(short, stop(w) - size(w) + 1, size(w))
    every = F.sequence(F.lit(0), last)
    steps = _let(F.transform(every, lambda w: _masks(piece(w))), lambda maps: F.transform(
        _chars(F.reverse(long)), lambda c: F.transform(maps, lambda m: F.coalesce(F.element_at(m, c), F.lit(0).cast("bigint")))))

    def word(acc: Column, x: Column) -> Column:
        return _let(x["v"].bitwiseAND(x["m"]), lambda u: _let(x["v"] + u + acc["carry"], lambda total: F.struct(
            F.concat(acc["out"], F.array(total.bitwiseAND(F.lit(_FULL)).bitwiseOR(x["v"] - u))).alias("out"),
            F.shiftright(total, WORD_BITS).alias("carry"))))

    def step(v: Column, m: Column) -> Column:
        pairs = F.zip_with(v, m, lambda x, y: F.struct(x.alias("v"), y.alias("m")))
        return F.aggregate(pairs, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("carry")),
                           word, lambda acc: acc["out"])

    state = F.aggregate(steps, F.transform(every, lambda w: F.lit(_FULL)), step)
    zeros = F.zip_with(state, F.transform(every, size), lambda v, k: k - F.bit_count(v.bitwiseAND(_ones(k))))
    return F.aggregate(zeros, F.lit(0), lambda x, y: x + y.cast("int"))


def _by_length(a: Column, b: Column) -> Column:
    """(short, long); null where a side is."""
    both = F.when(F.length(a) <= F.length(b), F.struct(a.alias("s"), b.alias("t"))).otherwise(
        F.struct(b.alias("s"), a.alias("t")))
    return F.when(a.isNotNull() & b.isNotNull(), both)


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; null where a side is."""
    return _let(_by_length(a, b), lambda p: F.when(p.isNotNull(), F.when(
        F.length(p["s"]) <= WORD_BITS, _lcs_word(p["s"], p["t"])).otherwise(_lcs_words(p["s"], p["t"]))))


def _window_best(short: Column, long: Column) -> Column:
    """Best ratio of ``short`` (one character or more) to windows of its length in ``long``, cut off at both ends.

    A window that ends (one cut off at the right: begins) with a character foreign to ``short`` is no
    better than its neighbour, so only the others are tried.
    """
    n, m = F.length(short), F.length(long)
    starts = F.sequence(1 - n, m - 1)
    begin = lambda s: F.greatest(s, F.lit(0))
    size = lambda s: F.least(s + n, m) - begin(s)
    ratio = lambda common, s: 200.0 * common / (n + size(s))
    # Places of the reversed text: a window that ends at place e begins there m - e.
    edge = lambda s: F.when(s + n <= m, begin(s) + size(s)).otherwise(begin(s) + 1)
    one = _let(_found(_masks(short), _chars(F.reverse(long))), lambda ms: F.array_max(F.transform(
        F.filter(starts, lambda s: F.element_at(ms, m - edge(s) + 1) != 0),
        lambda s: ratio(_matched(F.slice(ms, m - begin(s) - size(s) + 1, size(s)), n), s))))
    many = F.array_max(F.transform(starts, lambda s: ratio(lcs(short, F.substring(long, begin(s) + 1, size(s))), s)))
    return F.coalesce(F.when(n <= WORD_BITS, one).otherwise(many), F.lit(0.0))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter text against windows of the longer one; null where a side is."""
    def best(p: Column) -> Column:
        s, t = p["s"], p["t"]
        return (F.when(F.length(s) == 0, F.when(F.length(t) == 0, 100.0).otherwise(0.0))
                .when(F.contains(t, s), 100.0)
                .when(F.length(s) == F.length(t), F.greatest(_window_best(s, t), _window_best(t, s)))
                .otherwise(_window_best(s, t)))

    return _let(_by_length(a, b), lambda p: F.when(p.isNotNull(), best(p)))


def _phrase_ratio(header: str, alias: str, floor: float) -> float:
    """Best of whole, token-set and partial ratio; 0 when it cannot reach ``floor``."""
    n, m = len(alias), len(header)
    shared = sum(min(alias.count(ch), header.count(ch)) for ch in set(alias))
    longest = n >= 4
    bound = 200.0 * shared / (n + m)
    bound_partial = 0.96 * 200.0 * shared / (min(n, m) + shared) if longest and shared else 0.0
    left, right = set(header.split()), set(alias.split())
    common = left & right
    if not common and max(bound, bound_partial) < floor:
        return 0.0
    best = _ratio(header, alias)
    only_a = " ".join(sorted(left - common))
    only_b = " ".join(sorted(right - common))
    s, a, b = len(" ".join(sorted(common))), len(only_a), len(only_b)
    sep = 1 if s else 0
    if s and not (a and b):
        return 100.0
    dist = a + b - 2 * lcs_length(only_a, only_b)
    best = max(best, 100.0 - 100.0 * dist / (2 * (s + sep) + a + b))
    if s:
        best = max(best, 100.0 - 100.0 * (1 + a) / (2 * s + 1 + a),
                   100.0 - 100.0 * (1 + b) / (2 * s + 1 + b))
    if longest and bound_partial >= max(best, floor):
        best = max(best, 0.96 * _best_window(header, alias))
    return best


def indel_ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        100.0 - 100.0 * (total - 2 * lcs(a, b)) / total)


def subset_match(a: Column, b: Column) -> Column:
    """Similarity is exactly 100: the token sets meet and one holds the other."""
    return (F.size(F.array_intersect(a, b)) > 0) & (
        (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def nothing_shared(a: Column, b: Column) -> Column:
    """Similarity is exactly 0: a side has no tokens, or no character is common."""
    chars_a, chars_b = F.split(F.array_join(a, " "), ""), F.split(F.array_join(b, " "), "")
    return (F.size(a) == 0) | (F.size(b) == 0) | (
        ~F.arrays_overlap(a, b) & ~F.arrays_overlap(chars_a, chars_b))


def set_parts(a: Column, b: Column) -> dict[str, Column]:
    """Common and one-sided tokens as joined strings, for token_set_score."""
    return {
        "common": F.array_join(F.sort_array(F.array_intersect(a, b)), " "),
        "only_a": F.array_join(F.sort_array(F.array_except(a, b)), " "),
        "only_b": F.array_join(F.sort_array(F.array_except(b, a)), " "),
    }


def token_set_score(common: Column, only_a: Column, only_b: Column, lcs_len: Column) -> Column:
    """Token-set similarity from the parts and the LCS of the two remainders."""
    s, a, b = F.length(common), F.length(only_a), F.length(only_b)
    sep = F.when(s > 0, 1).otherwise(0)
    len_a, len_b = s + sep + a, s + sep + b
    r0 = 100.0 - 100.0 * (a + b - 2 * lcs_len) / (len_a + len_b)
    r1 = F.when(s > 0, 100.0 - 100.0 * (1 + a) / (s + len_a))
    r2 = F.when(s > 0, 100.0 - 100.0 * (1 + b) / (s + len_b))
    no_tokens = ((s + a) == 0) | ((s + b) == 0)
    return (F.when(no_tokens, F.lit(0.0))
            .when((s > 0) & ((a == 0) | (b == 0)), F.lit(100.0))
            .otherwise(F.greatest(r0, r1, r2)))


def similarity_band(score: Column, high: float, alert: float) -> Column:
    return (F.when(score >= high, "ALTA").when(score >= alert, "REVISAR").otherwise("BAIXA"))
