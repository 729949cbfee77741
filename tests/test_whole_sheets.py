"""Sheet queries that returned less than their operators, against brute force on a few files."""
import re
from collections import defaultdict

import pytest
from pyspark.sql import SparkSession

from bidframe.functions import similarity
from bidframe.operators import schema_match as sm
from bidframe.operators.concepts import phrases
from bidframe.plans import sheet_queries as sq
from bidframe.plans.registry import Inputs


@pytest.fixture(scope="module")
def t():
    spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    found = Inputs(spark, "/root/testdata/sf0.001")
    lines = found.lines.where("split(rfq_id, '-')[1] < 12")
    # Two files at most of each layout, cut off from the plan that made them.
    found.__dict__["lines"] = spark.createDataFrame(lines.collect(), lines.schema).coalesce(1)
    assert {int(r.rfq_id.split("-")[1]) % 6 for r in found.lines.collect()} == set(range(6))
    return found


def phrase_score(norm, alias):
    if norm == alias:
        return 100.0
    if re.search(rf"(^|\W){re.escape(alias)}($|\W)", norm):
        return min(97.0, 88.0 + 9.0 * len(alias) / len(norm))
    return similarity._phrase_ratio(norm, alias, 0.0)


def test_every_header_meets_every_phrase(t):
    headers = sq.Sheets(t).headers
    norms = {r.norm for r in headers.select("norm").collect()}
    got = {(r.norm, r.concept, r.alias): r.score for r in sq.score_alias(t).collect()}
    assert got.keys() == {(n, c, a) for n in norms for c, a in phrases()}
    for (n, _, a), score in got.items():
        assert score == pytest.approx(phrase_score(n, a), abs=1e-3), (n, a)


def test_every_sheet_is_classified(t):
    headers = sq.Sheets(t).headers.collect()
    got = {(r.file, r.sheet, r.col_idx): r for r in sq.classify_header(t).collect()}
    assert got.keys() == {(r.file, r.sheet, r.col_idx) for r in headers}
    exact = {alias: concept for concept, alias in phrases()}
    for h in headers:
        r = got[h.file, h.sheet, h.col_idx]
        if h.norm in exact and not set(h.norm.split(" ")) & set(sm.DERIVED_WORDS):
            assert (r.concept, r.confidence) == (exact[h.norm], "HIGH")
    assert any(r.header == "Campo A" for r in got.values())


def test_columns_of_every_sheet_are_resolved(t):
    columns = defaultdict(list)
    for r in sq.column_matches(t).collect():
        columns[r.file, r.sheet, r.concept].append((-(r.score + r.data_score), -r.data_score, r.col_idx))
    want, quotes = {}, {}
    for (file, sheet, concept), found in columns.items():
        found.sort()
        needed = concept in ("ID", *sm.REQUIRED_COLUMNS)
        if concept in (*sm.MAPPED, "QUOTE_ID") and (len(found) == 1 or needed and found[0][0] <= found[1][0] - 4):
            (quotes if concept == "QUOTE_ID" else want)[file, sheet, concept] = found[0][2]
    for (file, sheet, _), col_idx in quotes.items():
        if (file, sheet, "ID") not in columns:
            want[file, sheet, "ID"] = col_idx
    assert {(r.file, r.sheet, r.concept): r.col_idx for r in sq.resolve_columns(t).collect()} == want
    # Sheets of every style but the positional one are there.
    assert len({f for f, s, _ in want if s == "Dados"}) > len({f for f, *_ in columns}) / 2
