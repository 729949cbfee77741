"""Toxicity grades by cumulative-link ordinal regression."""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bidframe.llm.common import rows_of, texts

#: Most labelled rows of either label that the model is fitted on; words it keeps; grades above 0.
SAMPLE_ROWS, VOCABULARY, GRADES = 8_000, 256, 3
#: Texts, and share of the texts of either label, that must hold a word for it to be kept.
LEAST_TEXTS, LEAST_SHARE = 5, 0.01
#: Least size of the z-score of a word; below that the shares may differ by chance.
LEAST_Z = 4.0

_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigma(w . x - cuts[k]): one weight vector, ascending cuts."""

    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    #: A document is toxic if P(grade > 0) is at least this.
    reject: float = 0.5

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the sparse features: 1 + log(count) of known words."""
        found = Counter(w for w in tokens(text) if w in self.words)
        return (np.fromiter((self.words[w] for w in found), np.int64, len(found)),
                1 + np.log(np.fromiter(found.values(), float, len(found))))

    def above(self, text: str) -> np.ndarray:
        index, value = self.vector(text)
        return _sigma(float(self.weights[index] @ value) - self.cuts)


def _sigma(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = 2000, rate: float = 0.2, ridge: float = 1e-5):
    """Weights and cuts of the likelihood of P(grade > k), k = 0..K-1, by Adam steps.

    The cuts are a first value and positive steps, so they stay in order and the weights
    serve all of them.
    """
    n, k, share = len(grade), GRADES, weight / weight.sum()
    level = np.array([np.clip(share[grade <= j].sum(), 1e-3, 1 - 1e-3) for j in range(k)])
    start = np.maximum.accumulate(np.log(level / (1 - level)) + 1e-3 * np.arange(k))
    theta = np.concatenate([np.zeros(x.shape[1]), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v, d = np.zeros_like(theta), np.zeros_like(theta), x.shape[1]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[d + 1:])
        cuts = theta[d] + np.concatenate([[0], np.cumsum(gaps)])
        over = _sigma((x @ theta[:d])[:, None] - cuts)
        edge = np.column_stack([np.ones(n), over, np.zeros(n)])
        p = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-9)
        slope = np.column_stack([np.zeros(n), over * (1 - over), np.zeros(n)])
        low, high = share * slope[rows, grade] / p, share * slope[rows, grade + 1] / p
        by_cut = np.array([high[grade == j].sum() - low[grade == j + 1].sum() for j in range(k)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([x.T @ (low - high) - ridge * theta[:d], [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:d], theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1:]))])


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The limit on ``p`` with the fewest errors, halfway (in logarithms) to the next lower value."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    wrong = np.cumsum(1 - y) + y.sum() - np.cumsum(y)
    ends = np.flatnonzero(np.append(p[1:] < p[:-1] - 1e-9, True))
    k = ends[np.argmin(wrong[ends])]
    below = p[k + 1] if k + 1 < len(p) else p[k] / 2
    return float(np.exp(np.log(np.maximum([p[k], below], 1e-12)).mean()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on at most ``sample_rows`` labelled documents of each label, first in hash order.

    The labels say only whether a text is toxic; its grade is made from them. Copies of a text count once. Words are
    ranked by how much more often toxic texts of the sample hold them (a z-score of the two
    shares), and a toxic text is graded 1 to 3 by the terciles of its count of such words
    among the toxic texts. An id with several labels counts with the largest; null ids and
    other labels are not used. Without labels of both kinds nothing is found toxic.
    """
    clean = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(label_col).alias("_y")))
    chosen = None
    for y in (0, 1):
        part = clean.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    picked = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
              .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
              .select("_y", "text", F.xxhash64("text").alias("_h")).dropDuplicates(["_y", "_h"]).select("_y", "text"))

    def pairs(batches):
        for batch in batches:
            for y, text in zip(batch.column(0), texts(batch, 1)):
                found = list(dict.fromkeys(tokens(text)))
                yield rows_of({"y": (pa.int32(), [y.as_py()] * (len(found) + 1)),
                               "word": (pa.string(), [*found, None])})

    counts = (picked.mapInArrow(pairs, "y int, word string").groupBy("word")
              .agg(F.sum("y").cast("double").alias("toxic"), F.sum(1 - F.col("y")).cast("double").alias("other")))
    counts = counts.where(f"word is null or toxic + other >= {LEAST_TEXTS}")
    totals = counts.where("word is null").first()
    if totals is None or not totals.toxic or not totals.other:
        return Ordinal({}, np.zeros(0), np.full(GRADES, 40.0))
    a, b = F.col("toxic") / totals.toxic, F.col("other") / totals.other
    pooled = (F.col("toxic") + F.col("other") + 1) / (totals.toxic + totals.other + 2)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / totals.toxic + 1 / totals.other))
    ranked = (counts.where("word is not null").where(F.greatest(a, b) >= LEAST_SHARE).select("word", z.alias("z"))
              .where(F.abs("z") >= LEAST_Z)
              .orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).collect())
    if not ranked:
        return Ordinal({}, np.zeros(0), np.full(GRADES, 40.0))
    model = Ordinal({r.word: i for i, r in enumerate(ranked)}, np.zeros(len(ranked)), np.zeros(GRADES))

    def vectors(batches):
        for batch in batches:
            found = [model.vector(t) for t in texts(batch, 1)]
            yield rows_of({"y": (pa.int32(), batch.column(0)),
                           "at": (pa.list_(pa.int64()), [i for i, _ in found]),
                           "value": (pa.list_(pa.float64()), [v for _, v in found])})

    rows = (picked.select(F.col("_y").cast("int").alias("_y"), "text")
            .mapInArrow(vectors, "y int, at array<bigint>, value array<double>").limit(8 * sample_rows).collect())
    rows.sort(key=lambda r: (r.y, r.at, r.value))
    x, y = np.zeros((len(rows), len(ranked))), np.array([r.y for r in rows])
    for i, r in enumerate(rows):
        x[i, r.at] = r.value
    telling = np.array([r.z > 10 or r.z > 0.3 * ranked[0].z for r in ranked])
    weight = np.exp(x[:, telling] - 1).sum(1, where=x[:, telling] > 0)
    steps = np.quantile(weight[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + (weight[:, None] > steps).sum(1), 0)
    # Most texts without a known word are alike: each different row counts once, with its number.
    table, counts = np.unique(np.column_stack([x, grade]), axis=0, return_counts=True)
    weights, cuts = fit(table[:, :-1], table[:, -1].astype(int), counts.astype(float))
    # A text without any known word gives no reason to reject it.
    least = float(np.nextafter(_sigma(-cuts[0]), 1))
    return Ordinal(model.words, weights, cuts, max(least, best_cut(_sigma(x @ weights - cuts[0]), y)))


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``expected_severity``, ``p_toxic``, ``severity``, ``toxic``), a row for each of ``docs``.

    The expected severity is the sum over k of P(grade > k), from 0 to 3; ``severity`` is the
    number of grades passed with at least even odds. Whole texts are read; null and empty
    ones have no words, get the model's base rate and are not toxic. Repeated rows and null ids stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p = np.array([model.above(t) for t in texts(batch, 1)]).reshape(-1, GRADES)
            yield rows_of({"doc_id": (batch.schema.field(0).type, batch.column(0)),
                           "expected_severity": (pa.float64(), p.sum(1)), "p_toxic": (pa.float64(), p[:, 0]),
                           "severity": (pa.int32(), (p >= 0.5).sum(1).astype(np.int32)),
                           "toxic": (pa.bool_(), p[:, 0] >= model.reject)})

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, expected_severity double, p_toxic double, severity int, toxic boolean"))


def keep_clean(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """``docs`` without the toxic ones; every column stays as it is."""

    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [bool(model.above(t)[0] < model.reject) for t in texts(batch, at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
