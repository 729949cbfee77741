"""Hard negatives by an inverted multi-index: exact windows of integer inner products."""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bidframe.llm.common import cut, rows_of

#: Rows that the codebooks are fitted on, at most; every row is indexed.
SAMPLE_ROWS = 20_000
#: Rows of a cell on average, and centres of a half's codebook, at least and at most.
CELL_ROWS, LEAST_CODES, MOST_CODES = 1_000, 8, 256
#: Rows of a block of a cell, and anchors that meet a block at once; both bound a task's memory.
BLOCK_ROWS, MET_ANCHORS = 2_048, 2_048
#: Rows that each anchor sees before its limits are set.
FIRST_ROWS = 1_000
#: Components beyond this, once scaled, leave the range of exact scores.
LARGEST = 1 << 25

CODED = "id bigint, label bigint, dim int, cell int, near1 double, near2 double, vec binary"
DEMANDS = "dim int, cell int, anchor bigint, label bigint, vec binary, positives array<bigint>, lows array<bigint>, highs array<bigint>"


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = x.shape[1] // 2
    return x[:, :at], x[:, at:]


def _centres(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """k-means from the points farthest from those taken before."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    taken, away = [points[0]], np.full(len(points), np.inf)
    while len(taken) < min(codes, len(points)):
        away = np.minimum(away, ((points - taken[-1]) ** 2).sum(1))
        taken.append(points[away.argmax()])
    centres = np.array(taken)
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * points @ centres.T).argmin(1)


@dataclass
class Index:
    """Codebooks of the two halves, the radius of every code, and the rows of every cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    rows: dict[int, int] | None = None

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector and its distance to the centre in both halves."""
        codes, far = [], []
        for half, book in zip(_halves(x), self.books):
            own = _nearest(half, book)
            codes.append(own)
            far.append(np.sqrt(((half - book[own]) ** 2).sum(1)))
        return codes[0] * len(self.books[1]) + codes[1], far[0], far[1]

    def visit(self, q: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """Cells that hold rows, by falling bound of the inner product with ``q``: cell, least, most.

        The bound is the sum of the bounds of both halves, centre and radius, so the heap that walks
        the two sorted lists meets cells in order. Bounds have room for rounding.
        """
        middle, reach, order = [], [], []
        for half, book, radius in zip(_halves(q[None]), self.books, self.radii):
            size = np.sqrt((half ** 2).sum())
            middle.append(book @ half[0])
            reach.append(size * radius * (1 + 1e-9) + 1e-9 * (size * np.sqrt((book ** 2).sum(1)) + 1))
            order.append(np.argsort(-(middle[-1] + reach[-1]), kind="stable"))
        tops = [(m + r)[o] for m, r, o in zip(middle, reach, order)]
        heap, met = [(-(tops[0][0] + tops[1][0]), 0, 0)], {(0, 0)}
        while heap:
            top, i, j = heapq.heappop(heap)
            a, b = order[0][i], order[1][j]
            cell = int(a) * len(self.books[1]) + int(b)
            if self.rows.get(cell):
                least = middle[0][a] + middle[1][b] - reach[0][a] - reach[1][b]
                yield cell, least - 1e-6, -top + 1e-6
            for step in ((i + 1, j), (i, j + 1)):
                if step not in met and step[0] < len(tops[0]) and step[1] < len(tops[1]):
                    met.add(step)
                    heapq.heappush(heap, (-(tops[0][step[0]] + tops[1][step[1]]), *step))


def _matrix(vecs) -> np.ndarray:
    """Vectors of one length, each stored as bytes of int32."""
    vecs = vecs.to_pylist() if not isinstance(vecs, list) else vecs
    return np.frombuffer(b"".join(vecs), np.int32).reshape(len(vecs), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where all sums stay below 2^53."""
    most = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _coded(indexes: dict[int, Index]):
    def run(batches):
        for batch in batches:
            dims = np.array([len(v) // 4 for v in batch.column(2).to_pylist()])
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                index = indexes.get(dim) or Index(tuple(np.zeros((1, h.shape[1])) for h in _halves(np.zeros((1, dim)))))
                cell, near1, near2 = index.place(_matrix(part.column(2)).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(cell), dim, np.int32)),
                     pa.array(cell.astype(np.int32)), pa.array(near1), pa.array(near2), part.column(2)],
                    ["id", "label", "dim", "cell", "near1", "near2", "vec"])

    return run


def _packed(scale: float):
    """Vectors scaled, rounded down and stored as bytes; those beyond LARGEST are left out."""

    def run(batches):
        for batch in batches:
            out = {"id": (pa.int64(), []), "label": (pa.int64(), []), "vec": (pa.binary(), [])}
            for id_, label, vec in zip(*batch.columns):
                x = np.floor(scale * np.array(vec.as_py(), np.float64))
                if np.abs(x).max(initial=0) <= LARGEST:
                    for (_, held), value in zip(out.values(), (id_.as_py(), label.as_py(), x.astype(np.int32).tobytes())):
                        held.append(value)
            yield rows_of(out)

    return run


def vectors(df: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
            label_col: str = "label") -> DataFrame:
    """``id``, ``label`` and packed integer ``vec`` of the rows that take part, one for each id."""
    x = F.col(vector_col)
    fit = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = df.where(fit & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        x.cast("array<double>").alias("vec"))
    return rows.mapInArrow(_packed(scale), "id bigint, label bigint, vec binary").groupBy("id").agg(
        F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")


def build(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, Index]]:
    """All ``rows`` with their cells, and the index of each length of vector.

    Codebooks are fitted on the ``sample_rows`` rows of the smallest hashes; radii and counts are of
    all rows. A length without a sampled row has one cell. Codes grow with the root of the rows.
    """
    sizes = {r["dim"]: r["n"] for r in rows.groupBy((F.octet_length("vec") / 4).cast("int").alias("dim")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vec").toArrow().column(0).to_pylist()
    books = {}
    for dim, n in sizes.items():
        x = [v for v in sample if len(v) == 4 * dim]
        codes = int(np.clip(np.ceil(np.sqrt(n / CELL_ROWS)), LEAST_CODES, MOST_CODES))
        x = _matrix(x).astype(np.float64).reshape(len(x), dim) if x else np.zeros((0, dim))
        books[dim] = Index(tuple(_centres(h, codes) for h in _halves(x)))
    coded = cut(rows.mapInArrow(_coded(books), CODED))
    # MOST_CODES^2 cells of each length at most.
    facts = coded.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("near1").alias("r1"),
                                             F.max("near2").alias("r2")).collect()
    for dim, index in books.items():
        index.radii, index.rows = tuple(np.zeros(len(b)) for b in index.books), {}
        for f in facts:
            if f["dim"] == dim:
                index.rows[f["cell"]] = f["n"]
                for radius, code, far in zip(index.radii, divmod(f["cell"], len(index.books[1])), (f["r1"], f["r2"])):
                    radius[code] = max(radius[code], far)
    return coded, books


def _demands(indexes, first: bool):
    """Cells that each anchor visits: first those of its first FIRST_ROWS rows by falling bound, later the
    others until the bound falls below all its limits. Columns of the input: anchor, label, dim, vec, positives,
    lows, highs, limit; a cell whose rows all lie above every window is passed over.
    """

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out: dict[str, list] = {k: [] for k in ("dim", "cell", "row")}
            for n, row in enumerate(rows):
                index = indexes.value[row["dim"]]
                q = np.frombuffer(row["vec"], np.int32).astype(np.float64)
                high, seen = max(row["highs"]), 0
                for cell, least, most in index.visit(q):
                    if most < row["limit"]:
                        break
                    if least > high:
                        continue
                    early, seen = seen < FIRST_ROWS, seen + index.rows[cell]
                    if first and not early:
                        break
                    if early == first:
                        for name, value in zip(out, (row["dim"], cell, n)):
                            out[name].append(value)
            at = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["dim"], pa.int32()), pa.array(out["cell"], pa.int32()),
                 *[batch.column(c).take(at) for c in ("anchor", "label", "vec", "positives", "lows", "highs")]],
                ["dim", "cell", "anchor", "label", "vec", "positives", "lows", "highs"])

    return run


def _met(same: bool, k: int):
    """For each anchor and window the first ``k`` rows of a block, of the same or of other labels."""

    def run(block: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, tuple] = {c: (pa.int64(), []) for c in ("anchor", "positive", "id", "score")}
        if block.num_rows and anchors.num_rows:
            block = block.sort_by("id")
            ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
            scores = _products(_matrix(anchors.column("vec")), _matrix(block.column("vec")))
            asked = anchors.drop_columns(["vec"]).to_pylist()
            for row, score in zip(asked, scores):
                able = ((labels == row["label"]) == same) & (ids != row["anchor"])
                for positive, low, high in zip(row["positives"], row["lows"], row["highs"]):
                    at = np.flatnonzero(able & (score >= low) & (score <= high))
                    # Rows lie by id, so a stable order settles ties.
                    at = at[np.argsort(-score[at], kind="stable")[:k]]
                    for (_, held), value in zip(out.values(), (np.full(len(at), row["anchor"]), np.full(
                            len(at), positive if positive is not None else -1), ids[at], score[at])):
                        held.extend(value.tolist())
        return pa.table({c: pa.array(v, t) for c, (t, v) in out.items()})

    return run


def _meet(coded: DataFrame, demands: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of every visited block for each anchor and window.

    Cells with many rows are cut into blocks, and the anchors that visit a cell into parts, so no
    task holds more than one of each; a block travels once for every MET_ANCHORS anchors.
    """
    keys = ["dim", "cell"]
    demands = cut(demands)
    wanted = demands.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / MET_ANCHORS).cast("int").alias("parts"))
    blocks = coded.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    # One row for each cell, MOST_CODES^2 of each length at most.
    shape = F.broadcast(wanted.join(blocks, keys))
    part, block = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = (coded.select(*keys, "id", "label", "vec").join(shape, keys)
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("part", F.explode(part)).drop("parts", "blocks"))
    asked = (demands.join(shape, keys).withColumn("part", F.pmod(F.xxhash64("anchor"), F.col("parts")).cast("int"))
             .withColumn("block", F.explode(block)).drop("parts", "blocks"))
    keys = [*keys, "block", "part"]
    met = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        _met(same, k), "anchor bigint, positive bigint, id bigint, score bigint")
    return cut(_first(met, k))


def _first(met: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k)


def _search(coded: DataFrame, indexes, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows in every window of every anchor, in two rounds.

    The first round looks at FIRST_ROWS rows of the best bounds. Where a window then holds ``k`` rows,
    only rows as good as its last can change it, so the second round stops at that score, and
    else at the window's lower end. Nothing beyond a stop can enter a window.
    ``asked``: anchor, label, dim, vec, positives, lows, highs (a window for each positive).
    """
    begun = asked.withColumn("limit", F.array_min("lows").cast("double"))
    early = _meet(coded, begun.mapInArrow(_demands(indexes, True), DEMANDS), same, k)
    full = early.where(F.col("rank") == k).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("positive", "score"))).alias("last"))
    limits = F.array_min(F.zip_with("positives", "lows", lambda p, low: F.coalesce(
        F.element_at(F.coalesce("last", F.create_map().cast("map<bigint,bigint>")), F.coalesce(p, F.lit(-1))), low)))
    later = (asked.join(full, "anchor", "left").withColumn("limit", limits.cast("double")).drop("last"))
    rest = _meet(coded, later.mapInArrow(_demands(indexes, False), DEMANDS), same, k)
    return _first(early.drop("rank").union(rest.drop("rank")), k)


def mine(df: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 10,
         least: int = 30, most: int = 90, scale: float = 256.0, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id",
         vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For every anchor and each of its positives the first ``negatives`` rows of other labels whose
    score lies between ``least`` and ``most`` percent of the positive's.

    Components become floor(scale * x); a score is the integer inner product with the anchor.
    Higher scores come first, ties by smaller id. Positives are the first rows of the
    anchor's label; anchors or positives with none yield no rows, and a positive below 0 has an
    empty window. ``is_anchor`` tells anchors by id. The result is exact.

    Rows with a null id, label or vector, or a null or non-finite component, or one that exceeds
    LARGEST once scaled, take no part; vectors meet those of their own length, of few lengths
    in all. Of rows that share an id the one of the smallest label (then vector) takes part.
    An empty table gives no rows; further columns are not read.
    """
    rows = cut(vectors(df, scale, id_col, vector_col, label_col))
    coded, books = build(rows, sample_rows)
    indexes = df.sparkSession.sparkContext.broadcast(books)
    anchors = coded.where(is_anchor(F.col("id"))).select(F.col("id").alias("anchor"), "label", "dim", "vec")
    all_ = F.lit(-(1 << 62)).cast("bigint"), F.lit(1 << 62).cast("bigint")
    open_ = anchors.withColumn("positives", F.array(F.lit(None).cast("bigint"))).withColumn(
        "lows", F.array(all_[0])).withColumn("highs", F.array(all_[1]))
    near = cut(_search(coded, indexes, open_, True, positives)).select(
        "anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    # 100 score between least and most times the positive's: whole numbers, rounded inwards.
    low = F.ceil((F.col("positive_score") * least).cast("decimal(30,0)") / 100).cast("bigint")
    high = F.floor((F.col("positive_score") * most).cast("decimal(30,0)") / 100).cast("bigint")
    windows = (near.withColumn("low", low).withColumn("high", high).where("low <= high").groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("positive", "low", "high"))).alias("w")))
    asked = anchors.join(windows, "anchor").select(
        "anchor", "label", "dim", "vec", F.col("w.positive").alias("positives"), F.col("w.low").alias("lows"),
        F.col("w.high").alias("highs"))
    found = _search(coded, indexes, asked, False, negatives)
    return found.join(near, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
