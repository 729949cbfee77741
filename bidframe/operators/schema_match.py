"""Header detection and column matching over the cells of many sheets at once.

Input is a ``cells`` table: file, sheet, row_idx, col_idx, value (text). As in a preview,
only the first rows of each sheet are looked at.
"""
from __future__ import annotations

import re
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from bidframe.config import HeaderThresholds
from bidframe.functions.phrases import scores as phrase_scores
from bidframe.functions.similarity import _phrase_ratio as pair_ratio
from bidframe.functions.text import clean_text, normalize_header, strip, tokens
from bidframe.operators.concepts import CONCEPTS, KEYS, PRIORITY, phrases

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHEET = ["file", "sheet"]
SAMPLE_ROWS = 100
HEADER_ROWS = 30
REQUIRED = ("DESCRIPTION", "UNIT_PRICE")
USEFUL = ("ID", "DESCRIPTION", "QUANTITY", "UNIT", "UNIT_PRICE", "TOTAL_PRICE", "SUPPLIER",
          "PAYMENT_DAYS", "DELIVERY_DAYS", "FREIGHT", "MIN_ORDER", "PROPOSAL_VALIDITY", "BENCHMARK",
          "NEW_RATE", "DIFFERENCE", "REDUCTION", "INCREASE", "STATUS", "OBSERVATION")

# Words of our own result columns, never of an input column.
DERIVED_WORDS = ("score", "similaridade", "elegivel", "recomendacao", "classificacao", "ranking",
                 "validacao", "divergencias")

# Sibling words that strengthen a concept, and by how much.
CONTEXT = {
    "UNIT_PRICE": (2, ("fornecedor", "supplier", "vendor", "preco")),
    "TOTAL_PRICE": (3, ("quantidade", "quantity", "qtd")),
    "PAYMENT_DAYS": (4, ("pagamento", "payment")),
    "DELIVERY_DAYS": (4, ("entrega", "delivery", "lead time")),
    "DESCRIPTION": (1, ("quantidade", "quantity", "unit", "unidade")),
}

# Cell texts read as units of measure.
UNIT_VALUES = ("un", "und", "unid", "unid.", "pc", "pct", "kg", "g", "l", "ml", "m", "cx",
               "caixa", "pacote", "pç", "hora", "h")

# Concepts by position in a sheet with headers "campo a", "campo b", ...
GENERIC_LAYOUT = ("ID", "DESCRIPTION", "UNIT", "QUANTITY", "SUPPLIER", "UNIT_PRICE", "TOTAL_PRICE",
                  "DELIVERY_DAYS", "PAYMENT_DAYS", "FREIGHT", "MIN_ORDER", "OBSERVATION")
GENERIC_PATTERN = r"(?i)^campo\s+[a-z]+$"

REQUIRED_COLUMNS = ("DESCRIPTION", "QUANTITY", "UNIT", "SUPPLIER", "UNIT_PRICE")
MAPPED = ("ID", *REQUIRED_COLUMNS, "TOTAL_PRICE", "PAYMENT_DAYS", "DELIVERY_DAYS", "MIN_ORDER",
          "FREIGHT", "PROPOSAL_VALIDITY", "OBSERVATION", "CATEGORY", "CURRENCY", "STATUS", "QUOTE_DATE")


def sample_cells(cells: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return cells.where(F.col("row_idx") < rows)


def clean_header(value: Column, col_idx: Column) -> Column:
    """Header text; an empty one is named by its position."""
    return F.coalesce(clean_text(value), F.concat(F.lit("Unnamed_"), (col_idx + 1).cast("string")))


def is_derived(normalized: Column) -> Column:
    words = F.array(*[F.lit(w) for w in DERIVED_WORDS])
    return F.arrays_overlap(F.split(normalized, " "), words)


# --- scoring of headers against the catalogue ----------------------------------------

#: A bonus can lift a score by this much at most, so phrases this close to 100 can tie.
NEAR_TOP = 100.0 - max(points for points, _ in CONTEXT.values())
#: Headers scored together.
SCORED_ROWS = 2_000


def _phrase_rows(catalogued: list[tuple[str, str]], every: bool = False):
    """For each header the phrases that can decide: equal or contained ones, and per concept the
    first of the best and those near the top; or ``every`` phrase."""
    names = [a for _, a in catalogued]
    inside = [re.compile(rf"(?:^|\W){re.escape(a)}(?:$|\W)") for a in names]
    concepts = {}
    for n, (concept, _) in enumerate(catalogued):
        concepts.setdefault(concept, []).append(n)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                texts = batch.column(0).slice(at, SCORED_ROWS).to_pylist()
                base = phrase_scores(texts, names, lambda h, a: pair_ratio(h, a, 0.0))
                keep = np.full(base.shape, True) if every else base >= NEAR_TOP
                for i, h in enumerate(texts):
                    for n, a in enumerate(names):
                        if a in h and (h == a or inside[n].search(h)):
                            base[i, n] = 100.0 if h == a else min(97.0, 88.0 + len(a) / len(h) * 9.0)
                            keep[i, n] = True
                for own in concepts.values():
                    keep[np.arange(len(texts)), np.array(own)[base[:, own].argmax(1)]] = True
                row, n = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([texts[i] for i in row], pa.string()), pa.array(n, pa.int32()),
                     pa.array([catalogued[j][0] for j in n], pa.string()),
                     pa.array([names[j] for j in n], pa.string()), pa.array(base[row, n], pa.float64())],
                    ["norm", "n", "concept", "alias", "base"])

    return run


def alias_scores(headers: DataFrame, extra=None, every: bool = False) -> DataFrame:
    """Scores of the catalogue phrases for each distinct normalized header ``norm``.

    Phrases that neither equal nor stand in the header nor can be the best of their concept
    are left out, unless ``every`` one is asked for. Headers are dealt out by hash, so the work is spread however few bytes
    they take.
    """
    parts = int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (headers.select("norm").distinct().repartition(parts, "norm").mapInArrow(
        _phrase_rows(phrases(extra), every), "norm string, n int, concept string, alias string, base double"))


def context_flags(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Which context words the headers of each sheet contain, one flag per concept."""
    text = F.col("norm")
    flags = [F.max(reduce(lambda x, y: x | y, [text.contains(w) for w in words])).alias(f"ctx_{k}")
             for k, (_, words) in CONTEXT.items()]
    return headers.groupBy(*keys).agg(*flags)


FLAGS = [f"ctx_{k}" for k in CONTEXT]


def concept_scores(headers: DataFrame, extra=None) -> DataFrame:
    """Best phrase per concept for each distinct (norm, context flags) combination."""
    combos = headers.select("norm", *FLAGS).distinct()
    bonus = F.lit(0.0)
    for key, (points, _) in CONTEXT.items():
        bonus = F.when((F.col("concept") == key) & F.col(f"ctx_{key}"), float(points)).otherwise(bonus)
    scored = combos.join(alias_scores(headers, extra), "norm").withColumn(
        "s", F.least(F.col("base") + bonus, F.lit(100.0)))
    best = scored.groupBy("norm", *FLAGS, "concept").agg(
        F.max("s").alias("score"),
        F.min_by("alias", F.struct((-F.col("s")).alias("s"), "n")).alias("alias"))
    order = F.array_position(F.array(*[F.lit(k) for k in KEYS]), F.col("concept"))
    priority = reduce(lambda acc, c: acc.when(F.col("concept") == c.key, c.priority),
                      CONCEPTS[1:], F.when(F.col("concept") == CONCEPTS[0].key, CONCEPTS[0].priority))
    return best.select("norm", *FLAGS, "concept", "alias", F.round("score", 2).alias("score"),
                       priority.alias("priority"), order.alias("n"))


def rank_candidates(scores: DataFrame, k: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("norm", *FLAGS).orderBy(
        F.desc("score"), F.desc("priority"), "n"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def confidence(score: Column, th: HeaderThresholds) -> Column:
    return (F.when(score >= th.high, "HIGH").when(score >= th.medium, "MEDIUM")
            .when(score >= th.low, "LOW").otherwise("NONE"))


def classify(headers: DataFrame, th: HeaderThresholds = HeaderThresholds(),
             extra=None) -> DataFrame:
    """Concept of each distinct (norm, context flags) combination.

    No concept where the best score is low, or middling with a close runner-up, or the
    header is one of our own result columns. An exact phrase always wins.
    """
    top = rank_candidates(concept_scores(headers, extra), 2)
    first, second = F.col("place") == 1, F.col("place") == 2
    best = top.groupBy("norm", *FLAGS).agg(
        F.max(F.when(first, F.struct("concept", "score", "alias"))).alias("b"),
        F.max(F.when(second, F.col("score"))).alias("next"))
    exact = F.broadcast(exact_phrases(headers.sparkSession, extra))
    score, low = F.col("b.score"), F.lit(th.low)
    derived, known = is_derived(F.col("norm")) | (F.col("norm") == ""), F.col("exact").isNotNull()
    close = (score < th.medium) & (score - F.coalesce("next", F.lit(0.0)) < 3.0)
    none = (score < low) | close
    return (best.join(exact, "norm", "left").select(
        "norm", *FLAGS,
        F.when(derived, None).when(known, F.col("exact")).when(none, None)
        .otherwise(F.col("b.concept")).alias("concept"),
        F.when(derived, 0.0).when(known, 100.0).otherwise(score).alias("score"),
        F.when(derived, "NONE").when(known, "HIGH").when(none, "NONE")
        .otherwise(confidence(score, th)).alias("confidence"),
        F.when(derived, None).when(known, F.col("first_alias")).otherwise(F.col("b.alias")).alias("alias")))


def exact_phrases(spark, extra=None) -> DataFrame:
    """Phrase → concept and the leading phrase of that concept."""
    rows = phrases(extra)
    first = {concept: alias for concept, alias in reversed(rows)}
    return spark.createDataFrame([(alias, concept, first[concept]) for concept, alias in rows],
                                 "norm string, exact string, first_alias string")


def explain(headers: DataFrame, th: HeaderThresholds = HeaderThresholds(), extra=None) -> DataFrame:
    """Best match and the five best alternatives of each header."""
    alternatives = rank_candidates(concept_scores(headers, extra), 5).groupBy("norm", *FLAGS).agg(
        F.array_sort(F.collect_list(F.struct("place", "concept", "score", "alias"))).alias("alternatives"))
    return classify(headers, th, extra).join(alternatives, ["norm", *FLAGS])


def no_context(df: DataFrame) -> DataFrame:
    return df.withColumns({f: F.lit(False) for f in FLAGS})


# --- header row, data start, columns -------------------------------------------------


def contained_lengths(norms: DataFrame, extra=None) -> DataFrame:
    """``norm`` and the length of the longest phrase that stands in it as whole words, where one does."""
    known = exact_phrases(norms.sparkSession, extra).select(F.col("norm").alias("gram")).distinct()
    longest = max(len(alias.split(" ")) for _, alias in phrases(extra))
    words = F.split("norm", " ")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest))), lambda k: F.transform(
        F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    # The phrase list is short whatever the sheets hold.
    return (norms.select("norm", F.explode(F.array_distinct(grams)).alias("gram")).join(F.broadcast(known), "gram")
            .groupBy("norm").agg(F.max(F.length("gram")).alias("inside")))


def _row_points(high: Column, medium: Column, concepts: Column, named: Column) -> Column:
    """Points of a row from its cells with high and medium confidence, their concepts and the core concepts."""
    return (high * 18 + medium * 8 + concepts * 5 + F.col("cells") / F.col("width") * 10 + named
            - F.when(F.col("numeric") >= 0.25, 55).otherwise(0) - F.col("row_idx") * 0.15)


def _named_points(text: Column, price: Column) -> Column:
    return F.when(text & price, 35).when(text | price, 12).otherwise(0)


def open_rows(filled: DataFrame, width: DataFrame, th: HeaderThresholds = HeaderThresholds()) -> DataFrame:
    """The rows (sheet, row_idx) that may win as header, by what equal and contained phrases alone tell.

    They give every row a least number of points; at most, each cell with words adds a concept of high
    confidence. A row whose most is below the least of another row of its sheet is out, and with it the
    character scores of its cells. Sheets with a positional header have no open rows.
    """
    norms = filled.where("word").select("norm").distinct()
    exact = F.broadcast(exact_phrases(filled.sparkSession).select("norm", "exact").dropDuplicates(["norm"]))
    inside = contained_lengths(norms)
    known = norms.join(exact, "norm", "left").join(inside, "norm", "left")
    score = F.when(F.col("exact").isNotNull(), 100.0).otherwise(F.least(
        F.lit(97.0), 88.0 + 9.0 * F.col("inside") / F.length("norm")))
    sure = known.select("norm", "exact", confidence(score, th).alias("sure"), is_derived(F.col("norm")).alias("own"))
    usable = F.col("word") & ~F.coalesce(F.col("own"), F.lit(False))
    exact_one = F.when(usable, F.col("exact"))
    rows = filled.join(sure.where("exact IS NOT NULL OR sure <> 'NONE' OR own"), "norm", "left").groupBy(*SHEET, "row_idx").agg(
        F.count(F.lit(1)).alias("cells"), F.avg(F.col("number").cast("double")).alias("numeric"),
        F.count(F.when(F.col("generic"), 1)).alias("generic"), F.count(F.when(usable, 1)).alias("words"),
        F.count(F.when(usable & (F.col("sure") == "HIGH"), 1)).alias("high"),
        F.count(F.when(usable & (F.col("sure") == "MEDIUM"), 1)).alias("medium"),
        F.count_distinct(exact_one).alias("concepts"),
        *[F.max(F.coalesce(exact_one == c, F.lit(False))).alias(f"has_{n}") for n, c in enumerate(REQUIRED)])
    least = _row_points(F.col("high"), F.col("medium"), F.col("concepts"), _named_points(F.col("has_0"), F.col("has_1")))
    most = _row_points(F.col("words"), F.lit(0), F.col("words"), F.lit(35))
    bounds = rows.join(width, SHEET).withColumn("least", least).withColumn("most", most)
    best = bounds.groupBy(*SHEET).agg(F.max("least").alias("bar"), F.max("generic").alias("positional"))
    return (bounds.join(best, SHEET).where((F.col("most") >= F.col("bar")) & (F.col("positional") < GENERIC_LEAST))
            .select(*SHEET, "row_idx"))


#: Positional headers in a row that make it the header.
GENERIC_LEAST = 6


def find_header_row(cells: DataFrame, th: HeaderThresholds = HeaderThresholds(), header_rows: int = HEADER_ROWS,
                    sample_rows: int = SAMPLE_ROWS, keep=lambda df: df) -> DataFrame:
    """Header row of each sheet with its score; sheets without a sign get row 0.

    Only cells of rows that may still win (``open_rows``) are scored character by character.
    ``keep`` may write the steps that several others read.
    """
    sample = sample_cells(cells, sample_rows)
    width = sample.groupBy(*SHEET).agg((F.max("col_idx") + 1).alias("width"))
    digits = F.replace(F.regexp_replace("value", r"[^0-9,.\-]", ""), F.lit(","), F.lit("."))
    # A plain number shares at most a dot with one phrase: 48 points, so it names no concept.
    plain = F.lit(False) if th.low <= 50 else F.col("norm").rlike(r"^[0-9]+(\.[0-9]+)?$")
    filled = keep(sample.where(F.col("row_idx") < header_rows)
              .withColumn("header", clean_text(F.col("value"))).where(F.col("header").isNotNull())
              .withColumn("norm", normalize_header(F.col("header")))
              .withColumn("number", digits.try_cast("double").isNotNull())
              .withColumn("generic", F.col("header").rlike(GENERIC_PATTERN))
              .withColumn("word", ~plain & (F.col("norm") != "")))
    tried = keep(filled.join(open_rows(filled, width, th), [*SHEET, "row_idx"], "left_semi"))
    concepts = classify(no_context(tried.where("word").select("norm").distinct()), th).select("norm", "concept", "confidence")
    rows = tried.join(concepts, "norm", "left").groupBy(*SHEET, "row_idx").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count(F.when(F.col("confidence") == "HIGH", 1)).alias("high"),
        F.count(F.when(F.col("confidence") == "MEDIUM", 1)).alias("medium"),
        F.count_distinct("concept").alias("concepts"),
        F.max(F.coalesce(F.col("concept") == REQUIRED[0], F.lit(False))).alias("has_text"),
        F.max(F.coalesce(F.col("concept") == REQUIRED[1], F.lit(False))).alias("has_price"),
        F.avg(F.col("number").cast("double")).alias("numeric"))
    points = _row_points(F.col("high"), F.col("medium"), F.col("concepts"),
                         _named_points(F.col("has_text"), F.col("has_price")))
    best = rows.join(width, SHEET).withColumn("points", points).groupBy(*SHEET).agg(
        F.min_by("row_idx", F.when(F.col("points") > 0, F.struct(
            (-F.col("points")).alias("p"), "row_idx"))).alias("scored_row"),
        F.max("points").alias("top"))
    positional = (filled.where("generic").groupBy(*SHEET, "row_idx").agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") >= GENERIC_LEAST).groupBy(*SHEET).agg(F.min("row_idx").alias("generic_row")))
    row = F.coalesce("generic_row", "scored_row", F.lit(0))
    return width.join(best, SHEET, "left").join(positional, SHEET, "left").select(
        *SHEET, "width", row.cast("bigint").alias("header_row"),
        F.when(F.col("generic_row").isNotNull(), 40.0)
        .otherwise(F.round(F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)), 2)).alias("header_score"))


def find_data_start(cells: DataFrame, header_rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """First later row with two filled cells, as a 1-based row number."""
    sample = sample_cells(cells, sample_rows)
    last = sample.groupBy(*SHEET).agg((F.max("row_idx") + 1).alias("rows"))
    later = (sample.where(F.col("value").isNotNull()).join(header_rows, SHEET)
             .where(F.col("row_idx") > F.col("header_row"))
             .groupBy(*SHEET, "row_idx").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
             .groupBy(*SHEET).agg(F.min("row_idx").alias("first")))
    return (header_rows.join(last, SHEET).join(later, SHEET, "left")
            .select(*SHEET, F.coalesce(F.col("first") + 1, F.least(
                F.col("header_row") + 2, F.col("rows") + 1)).cast("bigint").alias("data_start")))


def sheet_headers(cells: DataFrame, header_rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every column of each sheet with its cleaned header, normalized form and context."""
    sample = sample_cells(cells, sample_rows)
    columns = header_rows.select(*SHEET, "header_row", F.explode(
        F.sequence(F.lit(0), F.col("width") - 1)).alias("col_idx"))
    found = columns.join(sample.withColumnRenamed("row_idx", "header_row"),
                         [*SHEET, "header_row", "col_idx"], "left")
    headers = (found.withColumn("header", clean_header(F.col("value"), F.col("col_idx")))
               .withColumn("norm", normalize_header(F.col("header")))
               .select(*SHEET, "header_row", "col_idx", "header", "norm"))
    return headers.join(context_flags(headers, SHEET), SHEET)


def loose_number(c: Column) -> Column:
    """Number of a preview cell: optional currency signs, one style of separators."""
    kept = F.regexp_replace(c, r"[^0-9,.\-]", "")
    comma, dot = kept.contains(","), kept.contains(".")
    comma_last = F.locate(",", F.reverse(kept)) < F.locate(".", F.reverse(kept))
    text = (F.when(comma & dot & comma_last, F.replace(
        F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & dot, F.replace(kept, F.lit(","), F.lit("")))
        .when(comma, F.replace(kept, F.lit(","), F.lit("."))).otherwise(kept))
    return F.when(c.rlike(r"(?i)^[\sR$€£+-]*\d[\d.,\s]*$"), text.try_cast("double"))


def column_profile(cells: DataFrame, header_rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Shape of the sampled values below the header of every column."""
    body = (sample_cells(cells, sample_rows).where(F.col("value").isNotNull())
            .join(header_rows.select(*SHEET, "header_row"), SHEET)
            .where(F.col("row_idx") > F.col("header_row"))
            .withColumn("text", strip(F.col("value")))
            .withColumn("number", loose_number(F.col("text")))
            .withColumn("unit", F.regexp_replace(F.lower("text"), r"\.+$", "")))
    number, n = F.col("number"), F.count(F.lit(1))
    numeric = F.count("number")
    whole = F.count(F.when(number % 1 == 0, 1))
    return body.groupBy(*SHEET, "col_idx").agg(
        n.alias("filled"), (numeric / n).alias("numeric"),
        F.coalesce(whole / F.nullif(numeric, F.lit(0)), F.lit(0.0)).alias("integer"),
        (1 - numeric / n).alias("text_share"),
        (F.count_distinct("text") / n).alias("unique_ratio"),
        F.median(F.length("text")).alias("median_length"),
        (F.count(F.when(F.col("text").rlike(r"(?i)R\$|\$|€|£"), 1)) / n).alias("currency"),
        F.count_distinct("unit").alias("distinct_values"),
        (F.count_distinct(F.when(F.col("unit").isin(*UNIT_VALUES), F.col("unit")))
         / F.count_distinct("unit")).alias("unit_ratio"))


def data_evidence(concept: str) -> Column:
    """Points for a concept from the profile columns; 0 without data."""
    text, uniq, number = F.col("text_share"), F.col("unique_ratio"), F.col("numeric")

    def plus(points, condition):
        return F.when(condition, float(points)).otherwise(0.0)

    if concept == "UNIT":
        return F.least(F.lit(26.0), 24 * F.col("unit_ratio") + plus(4, uniq <= 0.2))
    if concept == "DESCRIPTION":
        s = 12 * text + plus(6, F.col("median_length") >= 8) + plus(4, uniq >= 0.75)
    elif concept == "SUPPLIER":
        s = 12 * text + plus(8, (uniq < 0.8) & (F.col("distinct_values") >= 2))
    elif concept == "ID":
        s = 12 * text + plus(8, uniq >= 0.8) + plus(2, F.col("median_length") <= 40)
    elif concept in ("UNIT_PRICE", "TOTAL_PRICE"):
        s = 16 * number + 5 * F.col("currency") + 12 * (1 - F.col("integer"))
    elif concept == "QUANTITY":
        s = 16 * number + 4 * F.col("integer")
    elif concept in ("PAYMENT_DAYS", "DELIVERY_DAYS"):
        s = 16 * number
    else:
        return F.lit(0.0)
    return F.least(F.lit(22.0), s)


EVIDENCE = ("UNIT", "DESCRIPTION", "SUPPLIER", "ID", "QUANTITY", "UNIT_PRICE", "TOTAL_PRICE",
            "PAYMENT_DAYS", "DELIVERY_DAYS")
INFERRED = ("DESCRIPTION", "SUPPLIER", "UNIT", "ID", "QUANTITY", "UNIT_PRICE")


def evidence_scores(profile: DataFrame) -> DataFrame:
    return profile.withColumns({f"ev_{c}": data_evidence(c) for c in EVIDENCE})


def infer_concept(evidence: DataFrame) -> DataFrame:
    """Best concept by content alone, from 14 points; the first listed wins ties."""
    top = F.greatest(*[F.col(f"ev_{c}") for c in INFERRED])
    name = reduce(lambda acc, c: acc.when(F.col(f"ev_{c}") == top, c), INFERRED[1:],
                  F.when(F.col(f"ev_{INFERRED[0]}") == top, INFERRED[0]))
    return evidence.withColumn("inferred", F.when(top >= 14, name)).withColumn(
        "inferred_score", F.when(top >= 14, top))


def detect_columns(headers: DataFrame, profile: DataFrame,
                   th: HeaderThresholds = HeaderThresholds(), extra=None) -> DataFrame:
    """Concept of every column from its header, or from its content where that is weak."""
    by_header = headers.join(classify(headers, th, extra), ["norm", *FLAGS])
    facts = infer_concept(evidence_scores(profile))
    out = by_header.join(facts, [*SHEET, "col_idx"], "left")
    points = reduce(lambda acc, c: acc.when(F.col("concept") == c, F.col(f"ev_{c}")), EVIDENCE[1:],
                    F.when(F.col("concept") == EVIDENCE[0], F.col(f"ev_{EVIDENCE[0]}")))
    guess = F.col("confidence").isin("LOW", "NONE") & F.col("inferred").isNotNull()
    return out.select(
        *SHEET, "header_row", "col_idx", "header", "norm",
        F.when(guess, F.col("inferred")).otherwise(F.col("concept")).alias("concept"),
        "score", "confidence", "alias",
        F.round(F.when(guess, F.col("inferred_score")).otherwise(
            F.coalesce(points, F.lit(0.0))), 2).alias("data_score"),
        guess.alias("from_content"))


def select_sheet(columns: DataFrame, header_rows: DataFrame, cells: DataFrame,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The sheet of each file that looks most like quotes."""
    size = sample_cells(cells, sample_rows).groupBy(*SHEET).agg((F.max("row_idx") + 1).alias("rows"))
    facts = columns.groupBy(*SHEET).agg(
        F.count_distinct(F.when(F.col("concept").isin(*REQUIRED), F.col("concept"))).alias("required"),
        F.count_distinct(F.when(F.col("concept").isin(*USEFUL), F.col("concept"))).alias("useful"),
        F.count(F.when(F.col("confidence") == "HIGH", 1)).alias("high"),
        F.sum("data_score").alias("data_points"))
    ranked = (facts.join(header_rows, SHEET).join(size, SHEET)
              .withColumn("sheet_score", F.col("required") * 1000 + F.col("useful") * 50
                          + F.col("high") * 5 + F.col("data_points") + F.col("header_score")))
    place = F.row_number().over(Window.partitionBy("file").orderBy(
        F.desc("sheet_score"), F.desc("rows"), F.desc("width"), "sheet"))
    return (ranked.withColumn("place", place).where(F.col("place") == 1)
            .select("file", "sheet", F.round("sheet_score", 2).alias("sheet_score"), "required",
                    "useful", "high"))


def suppliers_in_headers(headers: DataFrame) -> DataFrame:
    """Supplier names written in front of a price or quantity header."""
    pattern = (r"(?i)(?U)^(.+?)\s*(?:-|–|—|\||:)\s*(?:preco|preço|valor|price|unit price|rate|"
               r"quantidade|qtd|quantity|unidade|unit|descricao|descrição|description)\b")
    name = F.btrim(F.regexp_extract(strip(F.col("header")), pattern, 1), F.lit(" -–—|_:"))
    return headers.select(*SHEET, name.alias("supplier")).where("supplier <> ''").distinct()


def detection_warnings(columns: DataFrame, header_rows: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Notes on sheets whose header or core columns are doubtful, one row each.

    ``manifest`` lists every sheet of every file; those without any cell are noted as empty.
    """
    has = {c: F.max(F.coalesce(F.col("concept") == c, F.lit(False))) for c in REQUIRED}
    facts = columns.groupBy(*SHEET).agg(
        *[v.alias(c) for c, v in has.items()],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("from_content"), F.struct("col_idx", "header")))), lambda x: x["header"]), ", ")
        .alias("guessed"))
    df = header_rows.join(facts, SHEET)
    missing = F.array_join(F.array_compact(F.array(
        *[F.when(~F.col(c), c) for c in sorted(REQUIRED)])), ", ")
    score = F.col("header_score")
    notes = F.array_compact(F.array(
        F.when(missing != "", F.concat(F.lit("Conceitos centrais não identificados: "), missing)),
        F.when(score < 35, "Confiança baixa na identificação do cabeçalho."),
        F.when(score <= 0, F.concat(
            F.lit("Nenhum cabeçalho com sinais reconhecíveis foi encontrado; foi assumida a linha "),
            (F.col("header_row") + 1).cast("string"),
            F.lit(" como cabeçalho. Confira se a aba correta foi escolhida ou informe o nome da aba."))),
        F.when(F.col("guessed") != "", F.concat(
            F.lit("Campos inferidos pelo conteúdo das células: "), F.col("guessed"), F.lit("."))),
        F.when(missing != "", F.concat(
            F.lit("Aba '"), F.col("sheet"),
            F.lit("' selecionada com baixa confiança para DESCRIPTION + UNIT_PRICE.")))))
    out = df.select(*SHEET, F.explode(notes).alias("warning"))
    if manifest is None:
        return out
    empty = manifest.where("readable").join(header_rows.select(*SHEET), SHEET, "left_anti")
    return out.unionByName(empty.select(*SHEET, F.lit("Aba vazia.").alias("warning")))


# --- columns to concepts -------------------------------------------------------------


def generic_layout(headers: DataFrame) -> DataFrame:
    """Positional concepts of sheets with at least six ``campo x`` headers."""
    generic = headers.groupBy(*SHEET).agg(
        F.count(F.when(F.col("header").rlike(GENERIC_PATTERN), 1)).alias("n")).where("n >= 6")
    layout = F.element_at(F.array(*[F.lit(c) for c in GENERIC_LAYOUT]), F.col("col_idx") + 1)
    return (headers.where(F.col("col_idx") < len(GENERIC_LAYOUT)).join(generic, SHEET, "left_semi")
            .select(*SHEET, layout.alias("concept"), "col_idx"))


def resolve_columns(columns: DataFrame) -> DataFrame:
    """One column per concept; a required concept with two close columns is ambiguous.

    ``problem`` is null for mapped rows, else the violation code.
    """
    total = F.col("score") + F.col("data_score")
    window = Window.partitionBy(*SHEET, "concept").orderBy(F.desc("total"), F.desc("data_score"), "col_idx")
    ranked = (columns.where(F.col("concept").isin(*MAPPED, "QUOTE_ID")).withColumn("total", total)
              .withColumn("place", F.row_number().over(window))
              .withColumn("lead", F.lead("total").over(window)))
    uses = F.max("place").over(Window.partitionBy(*SHEET, "concept"))
    first = ranked.withColumn("uses", uses).where("place = 1")
    needed = F.col("concept").isin("ID", *REQUIRED_COLUMNS)
    clear = F.col("total") >= F.col("lead") + 4
    picked = first.select(
        *SHEET, "concept",
        F.when((F.col("uses") == 1) | (needed & clear), F.col("col_idx")).alias("col_idx"),
        F.when((F.col("uses") > 1) & needed & ~clear, "coluna_ambigua").alias("problem"))
    stand_in = (picked.where("concept = 'QUOTE_ID' AND col_idx IS NOT NULL")
                .join(picked.where("concept = 'ID'"), SHEET, "left_anti")
                .select(*SHEET, F.lit("ID").alias("concept"), "col_idx", "problem"))
    return picked.where("concept <> 'QUOTE_ID'").unionByName(stand_in)


def column_map(resolved: DataFrame, generic: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Final column of each concept: the caller's, else the generic layout's, else detected."""
    keys = [*SHEET, "concept"]
    out = (resolved.withColumnRenamed("col_idx", "detected")
           .join(generic.withColumnRenamed("col_idx", "generic"), keys, "full"))
    if manual is not None:
        out = out.join(manual.withColumnRenamed("col_idx", "manual"), keys, "full")
    else:
        out = out.withColumn("manual", F.lit(None).cast("int"))
    col_idx = F.coalesce("manual", "generic", "detected")
    return out.select(*keys, col_idx.alias("col_idx"),
                      F.when(col_idx.isNull(), F.col("problem")).alias("problem"))


def manual_mapping(wanted: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve the caller's concept → position or header name; returns (good, bad).

    ``wanted``: file, sheet, concept, position (int or null), header (text or null).
    """
    by_name = headers.groupBy(*SHEET, "header").agg(F.min("col_idx").alias("named"))
    width = headers.groupBy(*SHEET).agg((F.max("col_idx") + 1).alias("width"))
    found = (wanted.join(by_name, [*SHEET, "header"], "left").join(width, SHEET, "left")
             .withColumn("col_idx", F.when(
                 F.col("position").isNotNull(),
                 F.when((F.col("position") >= 0) & (F.col("position") < F.col("width")), F.col("position")))
                 .otherwise(F.col("named"))))
    good = found.where(F.col("col_idx").isNotNull()).select(*SHEET, "concept", "col_idx")
    bad = found.where(F.col("col_idx").isNull()).select(
        *SHEET, "concept", F.when(F.col("position").isNotNull(), "posicao_invalida")
        .otherwise("coluna_manual_inexistente").alias("problem"))
    return good, bad


def missing_columns(mapped: DataFrame, sheets: DataFrame) -> DataFrame:
    """Required concepts a sheet lacks: violation ``colunas_nao_reconhecidas``."""
    need = sheets.select(*SHEET, F.explode(F.array(*[F.lit(c) for c in REQUIRED_COLUMNS])).alias("concept"))
    have = mapped.where(F.col("col_idx").isNotNull()).select(*SHEET, "concept")
    return need.join(have, [*SHEET, "concept"], "left_anti").withColumn(
        "problem", F.lit("colunas_nao_reconhecidas"))


def project_concepts(cells: DataFrame, header_rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row per data row with a column per concept; absent ones are null."""
    body = (cells.join(header_rows.select(*SHEET, "header_row"), SHEET)
            .where(F.col("row_idx") > F.col("header_row")))
    placed = body.join(mapped.where(F.col("col_idx").isNotNull())
                       .select(*SHEET, "concept", "col_idx"), [*SHEET, "col_idx"])
    return placed.groupBy(*SHEET, "row_idx").pivot("concept", list(MAPPED)).agg(F.first("value"))
