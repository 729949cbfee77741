"""Queries that returned less than their operators, against brute force on the smallest table."""
import pytest
from pyspark.sql import SparkSession

from bidframe.functions import similarity
from bidframe.operators import equalize as eq
from bidframe.plans import quote_queries as qq
from bidframe.plans.registry import Inputs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t():
    spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return Inputs(spark, DATA)


def ratio(a, b):
    return 100.0 * 2 * similarity.lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a, b):
    a, b = set(a), set(b)
    both, x, y = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if not a or not b:
        return 0.0
    if both and (not x or not y):
        return 100.0
    long = [f"{both} {z}".strip() for z in (x, y)]
    return max([ratio(*long), *([ratio(both, z) for z in long] if both else [])])


def key(r):
    return r.rfq_id, r.item_id, r.supplier


def test_every_status_and_band(t):
    scores = {}
    for r in qq._text_pairs(t).collect():
        scores[r.req_description, r.description] = token_set(r.ta, r.tb)
    got = {(r.req_description, r.description): (r.similarity, r.band) for r in qq.similarity_band(t).collect()}
    assert got.keys() == scores.keys()
    for k, v in scores.items():
        assert got[k][0] == pytest.approx(v, abs=1e-3)
        assert got[k][1] == ("ALTA" if got[k][0] >= 85 else "REVISAR" if got[k][0] >= 65 else "BAIXA")
    want = {}
    for r in t.chain.cells(False).collect():
        v = scores[r.req_description, r.description]
        broken = r.qty_check != "OK" or r.unit_check != "OK"
        want[key(r)] = (eq.NOT_QUOTED if v == 0 else "DIVERGÊNCIA ESTRUTURAL" if broken else "DIVERGÊNCIA" if r.attr_divergences
                        else "EQUIVALENTE" if v >= 100 else eq.REVISED if v >= 85 else eq.REVIEW if v >= 65 else eq.DIFFERENT)
    assert {key(r): r.eq_status for r in qq.eq_status(t).collect()} == want
    assert set(want.values()) & {eq.REVISED, eq.REVIEW, eq.DIFFERENT}
    shown = {key(r): r.status for r in qq.compact_map(t).collect()}
    assert {k: v for k, v in shown.items() if k in want} == want
    assert {v for k, v in shown.items() if k not in want} <= {eq.NOT_QUOTED}
    bands = {key(r): r for r in qq.severity_band(t).collect()}
    assert bands.keys() == want.keys()
    named = {"EQUIVALENTE": "good", eq.REVISED: "medium", eq.REVIEW: None}
    assert {k: r.status_band for k, r in bands.items()} == {k: named.get(v, "bad") for k, v in want.items()}
    spread = {(r.rfq_id, r.item_id): r.spread_pct for r in t.cmap.collect()}
    for k, r in bands.items():
        v = spread[k[:2]]
        assert r.spread_band == (None if v is None else "good" if v <= 5 else "medium" if v <= 15 else "bad")


def test_alerts_say_what_they_mean(t):
    found = qq.alerts(t).collect()
    assert found and all(r.message for r in found)
    assert all(r.supplier in r.message for r in found if r.supplier is not None)


def test_cells_are_compared_once(t, monkeypatch):
    """Bands and map, as well as recommendation and decision, read cells that were written once."""
    from bidframe.plans import sheet_queries
    from bidframe.plans.quotes import QuoteChain

    calls, plain = [], QuoteChain.cells
    monkeypatch.setattr(QuoteChain, "cells", lambda self, *a, **k: (calls.append(1), plain(self, *a, **k))[1])
    for query in (qq.severity_band, sheet_queries.respect_final_decision):
        calls.clear()
        assert query(Inputs(t.spark, DATA)).count() and len(calls) == 1
