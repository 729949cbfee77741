"""Quality scores by Bradley-Terry pairwise ranking."""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bidframe.llm.common import rows_of, texts

#: Most labelled rows the ranking is fitted on, and pairs drawn from them.
SAMPLE_ROWS, PAIRS = 20_000, 60_000
#: A score of at least this is predicted as label 1.
CUT = 0.7

_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90), "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "blank": np.isin(_BYTES, [9, 32]), "line": _BYTES == 10, "stop": np.isin(_BYTES, list(b".,;:")),
    "shout": np.isin(_BYTES, list(b"!?")), "symbol": np.isin(_BYTES, list(b"#$%&*+/<=>@\\^_`{|}~[]")),
    "bracket": np.isin(_BYTES, list(b"()\"'-")), "wide": _BYTES >= 128,
}
FEATURES = (*_CLASSES, "log_words", "word_length", "distinct", "top_word", "top_pair", "repeated_lines",
            "odd_words", "short_words", "long_words", "capital_words", "line_length", "empty")


def features(text: str) -> list[float]:
    """Shape of a whole text: shares of byte classes, repetition of words, pairs and lines."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [float(counts[which].sum()) / max(len(data), 1) for which in _CLASSES.values()]
    words = text.split()
    n = len(words)
    if not n:
        return [*shares, *[0.0] * (len(FEATURES) - len(shares) - 1), 1.0]
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n)
    odd = sum(c for w, c in seen.items() if not w[-1].isalnum() and not w[-1] in ".,;:" or not w[0].isalnum())
    capital = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [*shares, float(np.log1p(n)), float(lengths.mean()), len(seen) / n, max(seen.values()) / n,
            max(pairs.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1), odd / n,
            float((lengths <= 1).mean()), float((lengths > 20).mean()), capital / n,
            float(np.log1p(n / max(len(lines), 1))), 0.0]


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features and the raw score at the quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``CUT`` exactly at the threshold."""
        z = self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 60, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry: P(i before j) = sigma(w . (x_i - x_j)) over pairs of a good and a poor document.

    Newton steps on the logistic loss of feature differences. The threshold is the quantile
    of the raw scores at the share of label 0. With one label only, every score is ``CUT``.
    """
    mean = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    scale = np.where((s := x.std(0) if len(x) else np.ones(len(FEATURES))) > 1e-9, s, 1.0)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(len(FEATURES))
    if not len(good) or not len(poor):
        return Ranking(mean, scale, weights, 0.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    pairs = z[good[rng.integers(len(good), size=PAIRS)]] - z[poor[rng.integers(len(poor), size=PAIRS)]]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(pairs @ weights, -40, 40)))
        slope = pairs.T @ p / PAIRS - ridge * weights
        bend = (pairs * (p * (1 - p))[:, None]).T @ pairs / PAIRS + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weights
    # Halfway between the neighbours of the quantile, so that rounding doesn't tip a score.
    order, k = np.sort(raw), len(poor)
    threshold = float((order[k - 1] + order[min(k, len(order) - 1)]) / 2)
    return Ranking(mean, scale, weights, threshold, 1.0)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches):
    for batch in batches:
        values = np.array([features(t) for t in texts(batch, 1)]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values.T)], ["doc_id", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """Fit on at most ``sample_rows`` labelled documents, those first in hash order of the id.

    An id with several labels counts with the smallest; held-out ids, null ids and labels
    other than 0 and 1 are not used.
    """
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.min(label_col).alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    picked = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
              .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
              .select("_y", "text"))
    kinds = "doc_id int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = picked.select(F.col("_y").cast("int").alias("doc_id"), "text").mapInArrow(_features, kinds)
    # Ids may repeat among documents: the bound is on rows as well.
    table = rows.limit(4 * sample_rows).toArrow().sort_by([(c, "ascending") for c in ("doc_id", *FEATURES)])
    x = np.column_stack([table.column(f).to_numpy() for f in FEATURES])
    return fit(x, table.column("doc_id").to_numpy())


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``, ``predicted``), a row for each of ``docs``.

    Texts are scored whole; null and empty ones get the score of a text without words.
    Repeated rows get the same score each, null ids stay null and count as not held out;
    extra columns are not read. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in texts(batch, 2)]).reshape(-1, len(FEATURES))
            s = ranking.score(x)
            yield rows_of({"doc_id": (batch.schema.field(0).type, batch.column(0)),
                           "held_out": (pa.bool_(), batch.column(1)),
                           "score": (pa.float64(), s), "predicted": (pa.int32(), (s >= CUT).astype(np.int32))})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))
