"""Phrase collocations: frequent phrases by SON partitioning, scored by their weakest cut."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bidframe.llm.common import cut, shares, texts

#: Parts of the corpus that are mined apart; each must hold far more than ``min_count`` words.
SHARDS = 8
#: Bits of the filters of frequent phrases; a fuller filter costs work, not results.
FILTER_BITS = 1 << 26
#: Bytes of text held at once in a task, which bound its memory; a longer text makes a chunk of its own.
CHUNK_BYTES = 2_000_000

# Letters put in lower case, characters that end a piece, blanks between words.
_TABLE = bytes(32 if b == 9 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Odd multipliers of the two hashes of a word.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)]))
                                  for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


class _Chunk:
    """The words of some texts in a row: where they lie, their piece, language, shard and hashes."""

    def __init__(self, texts_: list[bytes], langs: list[str], shards: list[int], powers: list[_Powers]):
        self.data = b"\n".join(texts_).translate(_TABLE)
        raw = np.frombuffer(self.data, np.uint8)
        letter = np.concatenate([[False], (raw != 32) & (raw != 10), [False]])
        self.starts, self.ends = np.flatnonzero(letter[1:-1] & ~letter[:-2]), np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
        self.piece = np.cumsum(raw == 10)[self.starts]
        text = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts_[:-1]]), self.starts, "right") - 1
        names = sorted(set(langs))
        self.langs = pa.array(names, pa.string())
        self.lang = np.array([names.index(x) for x in langs], np.int32)[text]
        self.shard = np.array(shards, np.int32)[text]
        self.hashes = [self._hashes(raw, p) for p in powers]
        self.seeds = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little")
                               for n in names], np.uint64)

    def _hashes(self, raw: np.ndarray, powers: _Powers) -> np.ndarray:
        """A polynomial of each word's bytes modulo 2^64, from running sums."""
        up, down = powers.upto(len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        return _mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length whether a phrase begins at a word, its key of (language, phrase), and a second hash."""
        runs = list(self.hashes)
        for k in range(1, most + 1):
            if k > 1:
                runs = [_mix(run[:-1] * _MIX[2] + h[k - 1:]) for run, h in zip(runs, self.hashes)]
            n = max(len(self.starts) - k + 1, 0)
            yield k, self.piece[:n] == self.piece[k - 1:], _mix(runs[0] ^ self.seeds[self.lang[:n]]), runs[-1]

    def phrases(self, at: np.ndarray, k: int, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Distinct (language, phrase) of ``k`` words among the places: a place, count and text of each.

        Equal means both 64-bit hashes are; a place whose second one differs from its like's counts alone.
        """
        _, first, own = np.unique(key[at], return_index=True, return_inverse=True)
        odd = check[at] != check[at[first]][own]
        n = np.bincount(own[~odd], minlength=len(first))
        at, n = np.concatenate([at[first], at[odd]]), np.concatenate([n, np.ones(odd.sum(), n.dtype)])
        pieces = [self.data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + k - 1].tolist())]
        return at, n, [(p if b"  " not in p else b" ".join(p.split())).decode("utf-8", "surrogatepass") for p in pieces]


def _chunks(batches, most: int, bases: tuple[int, ...]) -> Iterator[_Chunk]:
    """Texts (column 0) with language and shard, up to ``most`` bytes or one longer text at a time."""
    powers, held, found = [_Powers(b) for b in bases], 0, ([], [], [])
    for batch in batches:
        for text, lang, shard in zip(texts(batch), batch.column(1), batch.column(2)):
            row = text.encode("utf-8", "surrogatepass"), lang.as_py(), shard.as_py()
            if found[0] and held + len(row[0]) > most:
                yield _Chunk(*found, powers)
                held, found = 0, ([], [], [])
            for values, value in zip(found, row):
                values.append(value)
            held += len(row[0]) + 1
    if found[0]:
        yield _Chunk(*found, powers)


def _shard_seeds(shards: int) -> np.ndarray:
    return _mix(np.arange(1, shards + 1, dtype=np.uint64) * _MIX[2])


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _local(lengths: range, seeds: np.ndarray, base: int = 0, bits=None):
    """Counts of the phrases of these lengths by language and shard; those of more than ``base``
    words only where all ``base`` in a row are in the filter of the shard."""

    def run(batches):
        for chunk in _chunks(batches, CHUNK_BYTES, _BASES[:1]):
            able = None
            for k, inside, keys, _ in chunk.grams(lengths[-1]):
                own = keys ^ seeds[chunk.shard[:len(keys)]]
                if k == base:
                    able = inside & _holds(bits.value, own)
                if k not in lengths:
                    continue
                hit = inside
                for j in range(k - base + 1 if base else 0):
                    hit = hit & able[j:j + len(hit)]
                at = np.flatnonzero(hit)
                _, first, n = np.unique(own[at], return_index=True, return_counts=True)
                at = at[first]
                yield pa.RecordBatch.from_arrays(
                    [chunk.langs.take(pa.array(chunk.lang[at])), pa.array(chunk.shard[at]),
                     pa.array(keys[at].view(np.int64)), pa.array(n)], ["lang", "shard", "key", "n"])

    return run


def _exact(most: int, bits):
    """Counts of the phrases whose key is in the filter, with their text."""

    def run(batches):
        for chunk in _chunks(batches, CHUNK_BYTES, _BASES):
            for k, inside, keys, check in chunk.grams(most):
                at, n, phrase = chunk.phrases(np.flatnonzero(inside & _holds(bits.value, keys)), k, keys, check)
                yield pa.RecordBatch.from_arrays(
                    [chunk.langs.take(pa.array(chunk.lang[at])), pa.array(phrase, pa.string()),
                     pa.array(np.full(len(at), k, np.int32)), pa.array(n)], ["lang", "phrase", "words", "n"])

    return run


def _filter(keys: DataFrame, key: Column):
    """The filter of all keys, sent to the tasks; only its FILTER_BITS bits come to the driver."""
    bit = key.bitwiseAND(F.lit(FILTER_BITS - 1))
    found = (keys.select(F.shiftright(bit, 6).alias("at"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
             .groupBy("at").agg(F.expr("bit_or(shiftleft(1L, place))").alias("b")).toArrow())
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("at").to_numpy()] = found.column("b").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def frequent_phrases(docs: DataFrame, most: int = 5, min_count: int = 100, shard_count: int = SHARDS, id_col: str = "doc_id",
                     text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Exact counts (``lang``, ``phrase``, ``words``, ``f``) of all phrases of up to ``most`` words that
    occur ``min_count`` times or more in their language, and the words of each (``lang``, ``n``).

    Documents are dealt into shards by id. A phrase that is frequent in all must hold at least its
    share of ``min_count``, by words, in some shard; so each shard is mined completely for
    those, word by word longer, and every task counts only phrases whose parts are frequent in
    the shard. The phrases of all shards together are then counted exactly over the corpus, by
    their text. Hashes and filters only let more through.
    """
    read = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.pmod(F.xxhash64(id_col), F.lit(shard_count)).cast("int").alias("shard"))
    seeds = _shard_seeds(shard_count)

    def counted(*how) -> DataFrame:
        return (read.mapInArrow(_local(*how), "lang string, shard int, key bigint, n bigint")
                .groupBy("lang", "shard", "key").agg(F.sum("n").alias("n")))

    words = cut(counted(range(1, 2), seeds))
    weights = words.groupBy("lang", "shard").agg(F.sum("n").alias("w"))
    total = F.sum("w").over(Window.partitionBy("lang"))
    # The smallest whole count that reaches the shard's share.
    limits = cut(weights.withColumn("all", total).withColumn("least", F.expr(
        f"(cast(w AS decimal(19,0)) * {min_count} + all - 1) div all")))
    often = lambda counts: cut(counts.join(limits, ["lang", "shard"]).where("n >= least").select("shard", "key"))
    own = F.col("key").bitwiseXOR(F.element_at(F.array(*[F.lit(int(s)) for s in seeds.view(np.int64)]), F.col("shard") + 1))

    found = [often(words)]
    for base, lengths in ((1, range(2, 3)), (2, range(3, 4)), (3, range(4, most + 1))):
        if lengths and lengths[0] <= most:
            found.append(often(counted(lengths, seeds, base, _filter(found[-1], own))))
    every = found[0]
    for level in found[1:]:
        every = every.union(level)
    exact = (read.mapInArrow(_exact(most, _filter(every, F.col("key"))), "lang string, phrase string, words int, n bigint")
             .groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))
    return cut(exact), limits.select("lang", F.col("all").cast("bigint").alias("n")).distinct()


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every phrase of two words or more at its weakest cut: ``a``, ``l``, ``r``, ``n`` and ``score``.

    The score of a cut is floor(1000 a n / (l r)), in whole numbers of up to 38 digits; of equal
    scores the shortest first part counts. Parts of a frequent phrase are frequent, so all are at hand.
    """
    part = lambda name: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    cuts = (phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"),
                                              F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("right", F.expr("substring_index(phrase, ' ', k - words)")))
    score = F.expr("cast((cast(1000 AS decimal(4,0)) * a) * cast(n AS decimal(19,0)) AS decimal(38,0)) div "
                   "cast(cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)) AS decimal(38,0))")
    return (cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"]).join(sizes, "lang")
            .withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("weakest"))
            .select("lang", "phrase", "words", "a", "weakest.l", "weakest.r", "n", "weakest.score"))


def without_parts(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """Candidates but those inside a longer one that occurs at least ``percent`` % as often."""
    words = F.split("phrase", " ")
    inner = F.expr("""flatten(transform(sequence(2, greatest(words - 1, 2)), k -> transform(
        sequence(1, greatest(words - k + 1, 1)), i -> array_join(slice(w, i, k), ' '))))""")
    longer = (candidates.where("words > 2").withColumn("w", words).select("lang", F.explode(inner).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    return (candidates.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer"))


def first_of_each(scores: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, ranked; a language is split over many tasks first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shares(scores.sparkSession)))
    part = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (scores.withColumn("salt", salt).withColumn("part", part).where(F.col("part") <= top)
            .withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).drop("salt", "part"))


def collocations(docs: DataFrame, top: int = 2_000, most: int = 5, min_count: int = 100, shard_count: int = SHARDS,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` collocations of each language with rank, phrase, a, l, r, n and score.

    Texts are put in lower case (A-Z), cut into pieces at punctuation and line ends, and these
    into words at blanks and tabs; a phrase lies within a piece. Null texts are empty, null
    languages ``und``, and every row counts, repeated ones and those without id too. Ties in
    score and count go by the bytes of the phrase. Tables without a frequent phrase give no
    rows; further columns are not read.
    """
    phrases, sizes = frequent_phrases(docs, most, min_count, shard_count, id_col, text_col, lang_col)
    return first_of_each(without_parts(scored(phrases, sizes)), top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
