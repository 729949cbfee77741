"""N-gram Jaccard join in metric space: pivots, regions, triangle windows, exact recursion.

Jaccard distance is a metric, but whole documents are poor pivots: any two unrelated texts
lie at distance 1, so every document would be on the boundary of every region. The pivots of
the first level are therefore the one-shingle sets {s}. A document of n shingles lies at
1 - 1/n from its own shingles and at 1 from all others; of the equal nearest ones the rarest
shingle decides, and names its home region. Documents within distance 1 - t share at least
t * n shingles, so at most n - ceil(t * n) shingles of either can miss the other: replicated
to the regions of its n - ceil(t * n) + w rarest shingles, each meets all its partners in w
regions or more (w is 3, or less for low t), which chance neighbours hardly do.

Inside a region documents are the pivots: all members are measured against the first one,
what links is one component, and only members of different components go on. These meet
within windows: |d(x, p) - d(y, p)| <= 1 - t for the pivots p measured so far.
"""
from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from bidframe.llm.common import components, cut, group, lowered_words, rows_of, shares, slices

#: Buckets of the word counts; shingles kept as frequent; both bound what is broadcast.
WORD_BUCKETS, HEAVY = 1 << 16, 1 << 16
#: New shingles after which a task's summary of frequent ones is brought down again.
SUMMARY_STEP = 500_000
#: Members up to which a region lists its open pairs; rows of a block beyond that.
SMALL_REGION, BLOCK_ROWS = 48, 1_000
#: Pairs that a task sums up before it hands them on.
PAIRS_HELD = 200_000
#: Bits of the filter that says which documents' sets are needed.
FILTER_BITS = 1 << 24

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = lowered_words(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, sorted, and the place where each first stands.

    A text of fewer than ``k`` words has its whole sequence as its one shingle.
    """
    n = len(words)
    if not n:
        return words, np.zeros(0, int)
    wide = min(n, k)
    h = np.full(n - wide + 1, wide, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(wide):
            h = _mix(h * _P + words[j:n - wide + 1 + j])
    return np.unique(h, return_index=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _summary(k: int):
    """Word counts by bucket and the frequent shingles of one task (Misra-Gries, in bulk)."""

    def run(batches):
        cache, words = _Words(), np.zeros(WORD_BUCKETS, np.int64)
        keys, counts, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def settle():
            nonlocal keys, counts, fresh, size
            new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *fresh]), return_counts=True)
            all_, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.bincount(at, np.concatenate([counts, n]), len(all_)).astype(np.int64)
            if len(total) > HEAVY:
                total -= np.partition(total, len(total) - HEAVY - 1)[len(total) - HEAVY - 1]
            keys, counts, fresh, size = all_[total > 0], total[total > 0], [], 0

        for batch in batches:
            for text in batch.column(0):
                w = cache.of(text.as_py())
                np.add.at(words, (w >> np.uint64(48)).astype(np.int64), 1)
                fresh.append(shingles(w, k)[0])
                size += len(fresh[-1])
                if size > SUMMARY_STEP:
                    settle()
        settle()
        some = np.flatnonzero(words)
        often = counts >= 2
        yield rows_of({"kind": (pa.int32(), np.repeat([0, 1], [len(some), often.sum()]).astype(np.int32)),
                       "key": (pa.int64(), np.concatenate([some, _signed(keys[often])])),
                       "n": (pa.int64(), np.concatenate([words[some], counts[often]]))})

    return run


class Rank:
    """Order of the shingles, rarest first: a level by frequency, then the hash.

    The level only has to be the same for a shingle everywhere. It is the binary logarithm
    of the count in the summary or of the count expected from the word frequencies,
    whichever is higher. Both tables are of fixed size and come from all texts.
    """

    def __init__(self, words: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        total = max(int(words.sum()), 1)
        self.log_share = np.log2((words + 1) / total)
        self.log_total = float(np.log2(total))
        order = np.argsort(keys)
        self.keys, self.levels = keys[order], np.floor(np.log2(np.maximum(counts[order], 1))).astype(np.int64)

    @staticmethod
    def of(texts: DataFrame, k: int) -> "Rank":
        found = cut(texts.mapInArrow(_summary(k), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
        words, keys = np.zeros(WORD_BUCKETS, np.int64), []
        for r in found.where("kind = 0").collect():
            words[r.key] = r.n
        keys = found.where("kind = 1").orderBy(F.desc("n"), "key").limit(HEAVY).collect()
        return Rank(words, np.array([r.key for r in keys], np.int64).view(np.uint64), np.array([r.n for r in keys], np.int64))

    def window(self, words: np.ndarray, found: np.ndarray, first: np.ndarray, k: int, size: int) -> np.ndarray:
        """The ``size`` rarest of the shingles ``found``."""
        level = np.zeros(len(found), np.int64)
        if len(words) >= k:
            share = self.log_share[(words >> np.uint64(48)).astype(np.int64)]
            expected = np.full(len(found), self.log_total)
            for j in range(k):
                expected = expected + share[first + j]
            level = np.floor(expected).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            level = np.where(self.keys[at] == found, np.maximum(level, self.levels[at]), level)
        return found[np.lexsort((found, level))[:size]]


def meetings(percent: int) -> int:
    """Regions in which similar documents must meet; sets that differ share percent / (100 - percent) shingles."""
    return 3 if percent >= 100 else max(1, min(3, percent // (100 - percent)))


def unseen(n, percent: int):
    """Shingles of a set of ``n`` (numbers or an array) that its window leaves out."""
    return np.maximum(-(-percent * n // 100) - meetings(percent), 0)


def needed(n, m, percent: int):
    """Least number of shingles that the windows of similar sets of ``n`` and ``m`` have in common.

    The window that ends first in the order of rarity holds all common shingles up to there, and so
    does the other; of the rest its set has ``unseen`` ones at most.
    """
    common = -(-percent * (n + m) // (100 + percent))
    return np.maximum(common - np.maximum(unseen(n, percent), unseen(m, percent)), meetings(percent))


def _needed(n, m, percent: int):
    """``needed`` of two columns."""
    left_out = lambda x: F.ceil(percent * x / 100) - meetings(percent)
    common = F.ceil(percent * (n + m) / (100 + percent))
    return F.greatest(common - F.greatest(left_out(n), left_out(m), F.lit(0)), F.lit(meetings(percent)))


def _windows(rank: Rank, k: int, percent: int):
    def run(batches):
        cache = _Words()
        for batch in slices(batches, 500):
            n, h1, h2, windows = [], [], [], []
            for text in batch.column(1):
                words = cache.of(text.as_py())
                found, first = shingles(words, k)
                n.append(len(found))
                with np.errstate(over="ignore"):
                    h1.append(_signed(found.sum(dtype=np.uint64, keepdims=True))[0])
                    h2.append(_signed(_mix(found ^ _P).sum(dtype=np.uint64, keepdims=True))[0])
                least = -(-percent * len(found) // 100)
                windows.append(_signed(rank.window(words, found, first, k, len(found) - least + meetings(percent))) if len(found) else [])
            yield rows_of({"doc_id": (pa.int64(), batch.column(0)), "n": (pa.int64(), n), "h1": (pa.int64(), h1),
                           "h2": (pa.int64(), h2), "window": (pa.list_(pa.int64()), windows)})

    return run


def _places(ids: np.ndarray) -> list[np.ndarray]:
    h = _mix(ids.view(np.uint64) + _P)
    return [(h & np.uint64(FILTER_BITS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) % FILTER_BITS]


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits of the ids in the one column: a fixed size, whatever their number; too many ids only make it let more pass."""

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False))))
            yield rows_of({"byte": (pa.int64(), at >> 6), "bits": (pa.int64(), np.left_shift(np.int64(1), at & 63))})

    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in ids.mapInArrow(run, "byte bigint, bits bigint").groupBy("byte").agg(F.bit_or("bits").alias("bits")).collect():
        bits[r.byte] = r.bits
    return bits


def _passed(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which ids the filter lets pass."""
    passed = np.ones(len(ids), bool)
    for at in _places(ids):
        passed &= (bits[at >> 6] >> (at & 63) & 1).astype(bool)
    return passed


def _sets(bits: np.ndarray, k: int):
    """Shingle sets of the documents that the filter lets pass."""

    def run(batches):
        cache = _Words()
        for batch in slices(batches, 500):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            passed = _passed(ids, bits)
            found = [_signed(shingles(cache.of(t.as_py()), k)[0]) for t in batch.column(1).filter(pa.array(passed))]
            yield rows_of({"id": (pa.int64(), ids[passed]), "shingles": (pa.list_(pa.int64()), found)})

    return run


def _near(a, b, percent: int):
    """Whether sizes alone allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets_of(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(``id``, ``shingles``) of at least the documents in ``ids``, made again from their texts."""
    return cut(texts.where("doc_id is not null").mapInArrow(_sets(_filter(ids), k), "id bigint, shingles array<bigint>"))


def _windows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(``x``, ``n``, ``window``) of at least the documents in ``ids``, each different one once."""
    bits = _filter(ids)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_passed(batch.column(0).to_numpy(zero_copy_only=False), bits)))

    able = rows.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("x"), "n", "window")
    return able.mapInArrow(run, "x bigint, n bigint, window array<bigint>").dropDuplicates(["x", "n", "window"])


def _checked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (``u``, ``v``) whose sets are similar enough, exactly."""
    pairs = cut(pairs)
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(texts, pairs.select("u").union(pairs.select("v")), k)
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    overlap = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - overlap
    return cut(both.where(100 * overlap >= percent * union).select("u", "v").distinct())


def _pairs(percent: int):
    """Open pairs of small regions (different components, sizes that can match), in how many they meet and must.

    The regions of a family share most pairs, so the meetings are summed here before they travel.
    """

    def run(batches):
        seen: Counter = Counter()
        least = cache(lambda n, m: int(needed(n, m, percent)))
        for batch in batches:
            for members, regions in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = sorted((m["x"], m["n"], m["component"]) for m in members.as_py())
                for i, (x, n, c) in enumerate(rows):
                    for y, m, d in rows[:i]:
                        if c != d and x != y and 100 * min(n, m) >= percent * max(n, m):
                            seen[y, x, least(n, m)] += regions
            if len(seen) > PAIRS_HELD:
                yield _pair_rows(seen)
                seen.clear()
        yield _pair_rows(seen)

    return run


def _pair_rows(seen: Counter) -> pa.RecordBatch:
    return rows_of({"u": (pa.int64(), [u for u, _, _ in seen]), "v": (pa.int64(), [v for _, v, _ in seen]),
                    "needed": (pa.int64(), [n for _, _, n in seen]), "times": (pa.int64(), list(seen.values()))})


class _Shared:
    """Sets of shingles by shingle: how many of its own each set shares with one of them."""

    def __init__(self, sets: list):
        self.count, sizes = len(sets), [len(x) for x in sets]
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
        self.stops = np.cumsum(np.bincount(place, minlength=len(values)))
        self.own = np.split(place, np.cumsum(sizes)[:-1])

    def with_(self, i: int) -> np.ndarray:
        found = [self.holders[self.stops[p - 1] if p else 0:self.stops[p]] for p in self.own[i]]
        return np.bincount(np.concatenate(found), minlength=self.count)


def able_members(a: list, b: list | None, percent: int) -> list:
    """Members (id, component, size, window) of two blocks, or within one, that may link with one of another component."""
    same, rows = b is None, [*a, *(b or [])]
    if not rows:
        return []
    shared, sizes = _Shared([r[3] for r in rows]), np.array([r[2] for r in rows])
    _, root = np.unique([r[1] for r in rows], return_inverse=True)
    found = np.zeros(len(rows), bool)
    for i in range(len(a)):
        able = root != root[i]
        able[:i + 1 if same else len(a)] = False
        able &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if not able.any():
            continue
        able &= shared.with_(i) >= needed(sizes, sizes[i], percent)
        found |= able
        found[i] |= able.any()
    return [r for r, is_able in zip(rows, found) if is_able]


def join_blocks(a: list, b: list | None, percent: int) -> list[tuple[int, int]]:
    """Links between members (id, component, sorted shingles) of two blocks, or within one; a forest of them.

    The first member is the pivot: members whose distances to it differ by more than the
    threshold can't link. Pairs already in one component are not compared.
    """
    same, rows = b is None, [*a, *(b or [])]
    if not rows:
        return []
    sizes, shared = np.array([len(r[2]) for r in rows]), _Shared([r[2] for r in rows])
    first = shared.with_(0)
    distance = 1 - first / (sizes + sizes[0] - first)
    _, root = np.unique([r[1] for r in rows], return_inverse=True)
    links, reach = [], 1 - percent / 100 + 1e-9
    for i in range(len(a)):
        able = root != root[i]
        able[:i + 1 if same else len(a)] = False
        able &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        able &= np.abs(distance - distance[i]) <= reach
        if not able.any():
            continue
        common = shared.with_(i)
        for j in np.flatnonzero(able & (100 * common >= percent * (sizes + sizes[i] - common))):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                links.append((rows[i][0], rows[j][0]))
    return links


def _blocks_met(rows: DataFrame) -> DataFrame:
    """Members of large regions, once for every two blocks of the region that meet there."""
    dealt = (rows.dropDuplicates(["s", "x"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return dealt.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "component")


def _sides(key, table: pa.Table, columns: tuple[str, ...]) -> tuple[list, list | None]:
    """Members of the two blocks that meet; the second is None where a block meets itself."""
    sides: dict[int, list] = {}
    for side, *member in zip(*(table.column(c).to_pylist() for c in ("own", *columns))):
        sides.setdefault(side, []).append((*member[:-1], np.sort(np.array(member[-1], np.int64))))
    first, second = key[1].as_py(), key[2].as_py()
    return sides.get(first, []), None if first == second else sides.get(second, [])


def _able(met: DataFrame, windows: DataFrame, percent: int) -> DataFrame:
    """The members whose windows alone don't rule out every link of their blocks."""

    def run(key, table):
        one, other = _sides(key, table, ("x", "component", "n", "window"))
        ids = {r[0] for r in able_members(one, other, percent)} if one and (other is None or other) else set()
        rows = table.select(["s", "i", "j", "own", "x", "component"])
        return rows.filter(pa.array([x in ids for x in table.column("x").to_pylist()], pa.bool_()))

    columns = "s bigint, i int, j int, own int, x bigint, component bigint"
    return met.join(windows, "x").groupBy("s", "i", "j").applyInArrow(run, columns).distinct()


def _open_links(rows: DataFrame, windows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of the open regions too large to list pairs: blocks of members meet two by two.

    Windows travel first; only members that have a possible partner send their whole sets.
    """

    def run(key, table):
        one, other = _sides(key, table, ("x", "component", "shingles"))
        links = join_blocks(one, other, percent) if one and (other is None or other) else []
        return pa.Table.from_batches([rows_of({"u": (pa.int64(), [x for x, _ in links]), "v": (pa.int64(), [y for _, y in links])})])

    able = cut(_able(_blocks_met(rows), windows, percent))
    if able.isEmpty():
        return able.select(F.col("x").alias("u"), F.col("x").alias("v"))
    sets = _sets_of(texts, able.select("x"), k).where("size(shingles) > 0").withColumnRenamed("id", "x").dropDuplicates(["x", "shingles"])
    return cut(able.join(sets, "x").groupBy("s", "i", "j").applyInArrow(run, "u bigint, v bigint"))


def similar_documents(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``), a row for each of ``docs``.

    Words are runs of anything but blanks and controls 09-0D, A-Z in lower case; a document
    is the set of its distinct ``k``-word shingles (fewer words: the whole sequence as one).
    Two documents link if 100 * intersection >= ``percent`` * union, decided exactly on
    64-bit hashes of the shingles. The component is the smallest id reachable by links.

    Documents with equal sets are one class and compared once. Null, empty and wordless
    texts have no shingles and link with nothing; neither do rows with a null id, whose
    component is null. Rows that share an id are separate texts under one name; classes whose
    smallest id is the same are one. Repeated rows stay; extra columns are not read; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rank = Rank.of(texts.select("text"), k)
    rows = cut(texts.mapInArrow(_windows(rank, k, percent), "doc_id bigint, n bigint, h1 bigint, h2 bigint, window array<bigint>")
               .withColumn("row", F.monotonically_increasing_id()))
    able = rows.where("n > 0 and doc_id is not null")
    classes = cut(able.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "row")).alias("low"))
                  .select("h1", "h2", "n", F.col("low.doc_id").alias("x"), F.col("low.row").alias("row")))
    cells = (able.select("row", "window").join(classes.select("row", "x", "n"), "row")
             .select(F.explode("window").alias("s"), "x", "n").repartition(shares(docs.sparkSession), "s"))
    regions = (cells.groupBy("s").agg(F.count("*").alias("m"), F.min("x").alias("c"), F.min_by("n", "x").alias("cn")).where("m > 1"))
    shared = cut(cells.join(regions, "s"))

    # Second level: the first member of a region is its pivot. Each document is measured
    # against the smallest pivot that it meets often enough, then against the others of
    # another component.
    stars = cut(shared.where((F.col("x") != F.col("c")) & _near(F.col("n"), F.col("cn"), percent))
                .groupBy(F.col("c").alias("u"), F.col("x").alias("v"))
                .agg(F.count("*").alias("times"), F.min(_needed(F.col("n"), F.col("cn"), percent)).alias("needed"))
                .where("times >= needed").select("u", "v"))
    links = _checked(stars.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), texts, k, percent)
    found = components(links)
    apart = (stars.join(found.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
             .join(found.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
             .where("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v"))
    links = cut(links.union(_checked(apart.join(links, ["u", "v"], "left_anti"), texts, k, percent)))
    found = components(links)

    # Third level: regions that still hold several components; equal regions once, with their number.
    # Only region and member travel until it is known which regions are open.
    labelled = (shared.select("s", "x").join(found.withColumnRenamed("node", "x"), "x", "left")
                .withColumn("component", F.coalesce("component", "x")))
    open_ = cut(labelled.groupBy("s").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("x")).alias("f"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("g"))
        .where("a <> b").groupBy("f", "g", "m").agg(F.min("s").alias("s"), F.count("*").alias("regions")))
    rest = cut(shared.select("s", "x", "n").join(open_.select("s", "m", "regions"), "s")
               .join(found.withColumnRenamed("node", "x"), "x", "left")
               .withColumn("component", F.coalesce("component", "x")))
    small = (rest.where(F.col("m") <= SMALL_REGION).groupBy("s", "regions")
             .agg(F.collect_list(F.struct("x", "n", "component")).alias("all"), F.min("x").alias("c"))
             .repartition(shares(docs.sparkSession), "c").select("all", "regions")
             .mapInArrow(_pairs(percent), "u bigint, v bigint, needed bigint, times bigint")
             .groupBy("u", "v").agg(F.sum("times").alias("times"), F.min("needed").alias("needed"))
             .where("times >= needed").select("u", "v"))
    more = _checked(small, texts, k, percent)
    large = rest.where(F.col("m") > SMALL_REGION)
    final = links.union(more)
    if not large.isEmpty():
        final = final.union(_open_links(large, _windows_of(rows, large.select("x")), texts, k, percent))
    final = components(final)

    known = (classes.join(final.withColumnRenamed("node", "x"), "x", "left")
             .select("h1", "h2", "n", F.coalesce("component", "x").alias("component_id")))
    answer = rows.select("doc_id", "n", "h1", "h2").join(known, ["h1", "h2", "n"], "left")
    # Rows that share an id may have different sets: they are linked through the id.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return answer.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id; rows without an id stay.

    Of repeated rows of one id the first by text stays.
    """
    from pyspark.sql import Window

    from bidframe.llm.common import free_name

    found = similar_documents(docs, k, percent, id_col, text_col).where("doc_id = component_id").select(
        F.col("doc_id").alias("_kept")).distinct()
    turn = free_name(docs, "_turn")
    kept = docs.join(found, F.col(id_col).cast("bigint") == F.col("_kept"), "left_semi")
    # Ids are nearly unique: the window only sees the rows of one id.
    first = kept.withColumn(turn, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))))
    return first.where(F.col(turn) == 1).drop(turn).unionByName(docs.where(F.col(id_col).isNull()))
