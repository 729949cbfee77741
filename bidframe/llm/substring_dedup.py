"""Substring deduplication by hashing of lines, the sentences they hold, and passages of words."""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bidframe.llm.common import cut, rows_of, shares, texts

_SPACE, _WORDS = re.compile(r"\s+"), re.compile(r"\S+")
UNITS = "doc_id bigint, unit bigint, start bigint, stop bigint, words bigint, d1 bigint, d2 bigint"

#: Units end at line breaks and after the stop of a sentence, since passages also stand within lines.
SPLIT = r"\n|(?<=[.!?])\s+"
#: Words of a passage that goes wherever in a unit it begins and ends.
PASSAGE_WORDS = 50
#: Bits of the filter of repeated fingerprints; a fuller filter costs work, not results.
FILTER_BITS = 1 << 26
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def normalise(unit: str) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return _SPACE.sub(" ", unit.lower()).strip()


def _units(split: str):
    breaks = re.compile(split)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "unit", "start", "stop", "words", "d1", "d2")}
            for doc, text in zip(batch.column(0), batch.column(1)):
                text, doc, at, number = text.as_py() or "", doc.as_py(), 0, 0
                ends = [*((m.start(), m.end()) for m in breaks.finditer(text)), (len(text), len(text))]
                for stop, after in ends:
                    unit = normalise(text[at:stop])
                    if unit:
                        digest = hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        halves = np.frombuffer(digest, np.int64)
                        for name, value in zip(out, (doc, number, at, stop, unit.count(" ") + 1, halves[0], halves[1])):
                            out[name].append(value)
                        number += 1
                    at = after
                if len(out["unit"]) > 20_000:
                    yield rows_of({k: (pa.int64(), v) for k, v in out.items()})
                    out = {k: [] for k in out}
            yield rows_of({k: (pa.int64(), v) for k, v in out.items()})

    return run


def _later(units: DataFrame) -> DataFrame:
    """The rows of UNITS that an earlier place holds too, with that place (``kept``) and ``copies``.

    Groups are reduced to their earliest member before anything meets, whatever their size;
    rows of the few largest groups find it in salted parts.
    """
    place = F.struct("doc_id", "unit")
    first = cut(units.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.count("*").alias("copies"))
                .where("copies > 1"))
    ways = shares(units.sparkSession)
    limit = (first.agg(F.sum("copies")).first()[0] or 0) // (4 * ways) + 1
    # At most 4 * ways digests can have more than the limit.
    hot = F.broadcast(first.where(F.col("copies") > limit).select("d1", "d2", F.lit(True).alias("hot")))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "unit"), F.lit(ways))).otherwise(0)
    left = units.join(hot, ["d1", "d2"], "left").withColumn("salt", spread.cast("int")).drop("hot")
    last = F.when(F.col("copies") > limit, ways - 1).otherwise(0)
    right = first.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    return left.join(right, ["d1", "d2", "salt"]).where(place != F.col("kept"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (docs.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))


def repeated_units(docs: DataFrame, split: str = SPLIT, min_words: int = 1, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Units to remove: every occurrence but the earliest of its digest, with original offsets.

    A text is cut at ``split`` (lines and sentences by default) into units; those without any character
    after normalising are no units. The earliest occurrence is that of the smallest id, then
    of the smallest place in the text. Of the others those go that stand in an unbroken row
    of repeated units with ``min_words`` words or more in all; by default each of them.

    Null and empty texts have no units. Rows without id are left alone. Rows that share an id
    count as one document: their like units at the same place are one occurrence. Extra
    columns are not read.
    """
    units = cut(_named(docs, id_col, text_col).mapInArrow(_units(split), UNITS))
    repeats = _later(units).dropDuplicates(["doc_id", "unit", "d1", "d2"])
    by_doc = Window.partitionBy("doc_id")
    run = F.col("unit") - F.dense_rank().over(by_doc.orderBy("unit"))
    total = F.sum("words").over(Window.partitionBy("doc_id", "run"))
    return (repeats.withColumn("run", run).withColumn("run_words", total).where(F.col("run_words") >= min_words)
            .select("doc_id", "unit", "start", "stop", "words", "run_words", _digest(),
                    F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.unit").alias("kept_unit"), "copies"))


def _digest():
    return F.lower(F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0"))).alias("digest")


class _Hashes(dict):
    """64-bit hashes of the words met, forgotten when they grow many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        self[word] = value = int.from_bytes(digest, "little")
        return value

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of every ``k`` words in a row: a polynomial modulo 2^64, from running sums."""
    n = len(hashes)
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
                for b in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def _anchors(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of half windows, and for each window the place of the smallest it holds."""
    k = max(1, words // 2)
    grams = _rolling(hashes, k, BASES[0])
    view = np.lib.stride_tricks.sliding_window_view(grams, words - k + 1)
    return grams, view.argmin(1) + np.arange(len(view))


def _fingerprints(words: int):
    def run(batches):
        known = _Hashes()
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in texts(batch):
                hashes = known.of(text)
                if len(hashes) >= words:
                    grams, at = _anchors(hashes, words)
                    found.append(grams[np.unique(at)])
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield rows_of({"f": (pa.int64(), values.view(np.int64)), "n": (pa.int64(), n)})

    return run


def _filter(repeated: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the fingerprints set; only the filter comes to the driver."""
    bit = F.pmod("f", F.lit(FILTER_BITS))
    found = (repeated.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(pmod(f, 64) AS int))").alias("b"))
             .groupBy("at").agg(F.bit_or("b").alias("b")).toArrow())
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("at").to_numpy()] = found.column("b").to_numpy()
    return bits.view(np.uint64)


def _windows(words: int, bits):
    """Windows whose smallest fingerprint is in the filter, as UNITS; ``unit`` is the number of the first word."""

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for doc, text in zip(batch.column(0), texts(batch, 1)):
                hashes = known.of(text)
                if len(hashes) < words:
                    continue
                grams, at = _anchors(hashes, words)
                own = grams[at] & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero((bits.value[own >> np.uint64(6)] >> (own & np.uint64(63))) & np.uint64(1))
                if not len(hit):
                    continue
                spans = np.array([m.span() for m in _WORDS.finditer(text)], np.int64)
                d1, d2 = (_rolling(x, words, b)[hit].view(np.int64) for x, b in zip((hashes, _mix(hashes)), BASES))
                yield rows_of({k: (pa.int64(), v) for k, v in {
                    "doc_id": np.full(len(hit), doc.as_py()), "unit": hit, "start": spans[hit, 0],
                    "stop": spans[hit + words - 1, 1], "words": np.full(len(hit), words), "d1": d1, "d2": d2}.items()})

    return run


def repeated_passages(docs: DataFrame, words: int = PASSAGE_WORDS, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Runs of words to remove, with original offsets: all that lie in ``words`` words in a row that an
    earlier place holds too, wherever lines and sentences break.

    Words are compared in lower case. Windows of ``words`` words are hashed (128 bit); a later one
    goes unless it overlaps its own earliest occurrence, and overlapping ones that go are one
    run. Equal windows have the same smallest fingerprint of half their length, so only those are
    hashed whose smallest fingerprint occurs twice, by a filter that may let others through.
    Columns as in ``repeated_units``: ``unit`` is null, ``digest``, ``kept_doc_id`` and ``copies``
    are those of the run's first window, ``words`` the words of the run.
    """
    named = _named(docs, id_col, text_col)
    repeated = (named.select("text").mapInArrow(_fingerprints(words), "f bigint, n bigint")
                .groupBy("f").agg(F.sum("n").alias("n")).where("n > 1"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(repeated))
    windows = cut(named.mapInArrow(_windows(words, bits), UNITS))
    apart = (F.col("kept.doc_id") != F.col("doc_id")) | (F.col("unit") >= F.col("kept.unit") + words)
    by_start = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") > F.col("reach")).cast("int"), F.lit(0))
    run = F.sum("begins").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min_by(F.struct(_digest(), F.col("kept.doc_id").alias("kept_doc_id"), "copies"), "start").alias("first")
    length = F.max("unit") - F.min("unit") + words
    return (_later(windows).where(apart).withColumn("reach", reach).withColumn("begins", begins)
            .withColumn("run", run).groupBy("doc_id", "run")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), length.alias("words"), first)
            .select("doc_id", F.lit(None).cast("bigint").alias("unit"), "start", "stop", "words",
                    F.col("words").alias("run_words"), "first.digest", "first.kept_doc_id",
                    F.lit(None).cast("bigint").alias("kept_unit"), "first.copies"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All to remove: repeated units, and repeated passages; these may overlap."""
    return (repeated_units(docs, id_col=id_col, text_col=text_col)
            .unionByName(repeated_passages(docs, id_col=id_col, text_col=text_col)))


def remove_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the units cut out of their texts, one character of each break with them."""
    # Cuts may overlap: each reaches as far as any before it.
    before = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    cuts = removed.select("doc_id", "start", F.max("stop").over(before).alias("stop")).groupBy(
        F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_cuts"))
    # The kept parts of a text lie between the end of one cut and the start of the next.
    stops = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_cuts", lambda c: c["stop"] + 1))
    starts = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.length(text_col).cast("bigint")))
    pieces = F.zip_with(stops, starts, lambda a, b: F.substring(
        F.col(text_col), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    joined = docs.join(cuts, F.col(id_col) == F.col("_doc"), "left")
    text = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(F.array_join(pieces, ""))
    return joined.withColumn(text_col, text).select(*docs.columns)
