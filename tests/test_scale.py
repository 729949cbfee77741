"""Steps that must stay small while the tables grow."""
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bidframe.operators import blocks, equalize as eq, matrix as mx  # noqa: E402
from bidframe.plans.registry import Inputs  # noqa: E402
from bidframe.plans.sheet_queries import Matrix  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
            .config("spark.ui.enabled", "false").getOrCreate())


def test_grid_names_meet_items_last(spark, monkeypatch):
    """The names of a block are not shuffled together with the items: one join stands above theirs."""
    monkeypatch.setattr(blocks, "BLOCK", 3)
    items = spark.createDataFrame([("r", str(i)) for i in range(6)] + [("q", "0")], "rfq_id string, item_id string")
    suppliers = spark.createDataFrame([("r", f"s{i}") for i in range(10)] + [("q", "s0"), ("q", None)],
                                      "rfq_id string, supplier string")
    offers = spark.createDataFrame([("r", "1", "s3", 5), ("r", "1", "s4", 6), ("r", "2", "s3", 7), ("q", "0", None, 1)],
                                   "rfq_id string, item_id string, supplier string, cents int")
    got = {tuple(r) for r in eq.quote_grid(items, offers, suppliers, ["cents"])
           .select("rfq_id", "item_id", "supplier", "cents", "has_offer").collect()}
    cents = {("1", "s3"): 5, ("1", "s4"): 6, ("2", "s3"): 7}
    assert got == {("r", str(i), f"s{j}", cents.get((str(i), f"s{j}")), (str(i), f"s{j}") in cents)
                   for i in range(6) for j in range(10)} | {("q", "0", "s0", None, False), ("q", "0", None, None, False)}
    missing = {(r.item_id, r.supplier) for r in eq.not_quoted(items, offers, suppliers).where("rfq_id = 'r'").collect()}
    assert missing == {(str(i), f"s{j}") for i in range(6) for j in range(10)} - set(cents)
    plan = blocks.item_blocks(items, offers, suppliers, ["cents"])._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[:3]
    assert any("Join Inner" in line and "block" in line and "_part" in line for line in top), top


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three parts, one of them never sold; a line of a supplier that does not exist."""
    to = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, "large ring", "B#1", "LARGE", 1), (2, "hot bolt", "B#1", "SMALL", 1), (3, "nut", "B#1", "SMALL", 1)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{to}/part.parquet")
    spark.createDataFrame([(1, "S#1"), (2, "S#2")], "s_suppkey long, s_name string").write.parquet(f"{to}/supplier.parquet")
    lines = [(1, 1, 1, 1, 15.0, 150.0), (1, 1, 2, 2, 15.0, 300.0), (2, 2, 1, 1, 20.0, 100.0), (2, 3, 9, 1, 20.0, 100.0)]
    spark.createDataFrame([(o, p, s, n, q, x, "N", "O", "1996-09-13") for o, p, s, n, q, x in lines],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate string"
                          ).write.parquet(f"{to}/lineitem.parquet")
    return str(to)


def test_parts_are_not_broadcast(spark, folder):
    t = Inputs(spark, folder)
    plan = t.lines._jdf.queryExecution().sparkPlan().toString()
    assert any("HashJoin" in x and "l_partkey" in x and "Broadcast" not in x for x in plan.splitlines())
    assert sorted((r.rfq_id, r.item_id) for r in t.items.collect()) == [("B#1-1", "1"), ("B#1-1", "2")]
    assert sorted((r.item_id, r.supplier, r.source_row) for r in t.lines.collect()) == [("1", "S#1", 1), ("1", "S#2", 2), ("2", "S#1", 3)]


def test_marked_cells_are_written_once(spark, folder):
    t = Inputs(spark, folder)
    assert "staged-" in "".join(t.marked.inputFiles()) and t.marked.count() == 3
    assert {r.supplier: r.quoted for r in t.summary.collect()} == {"S#1": 2, "S#2": 1}


def test_price_columns_follow_the_cells_not_the_width(spark):
    """Only the cells of two rows are met: a very wide sheet has no row for each of its columns."""
    far = 2_000_000_000
    cells = [(0, 5, "Acme"), (1, 5, "Unitário"), (1, 6, "Total"), (0, 7, " Beta "), (1, 8, "total"), (0, 9, "no"), (1, 9, "x"),
             (1, 10, "Total"), (0, 11, "no"), (1, 12, "y"), (1, 4, "Unitário"), (2, 5, "10"), (0, far, "Far"), (1, far, " UNITARIO ")]
    cells = spark.createDataFrame([("f", "s", *c) for c in cells], "file string, sheet string, row_idx long, col_idx int, value string")
    rows = spark.createDataFrame([("f", "s", 1, far + 1), ("g", "s", 1, 3)], "file string, sheet string, header_row long, width int")
    got = {(r.file, r.col_idx, r.label) for r in mx.price_columns(cells, rows).collect()}
    assert got == {("f", 5, "Acme"), ("f", 7, "Beta"), ("f", far, "Far")}


def test_matrix_cells_are_written_once(spark, folder):
    m = Matrix(Inputs(spark, folder))
    assert "staged-" in "".join(m.cells.inputFiles())
    rows = {r.row_idx: (r.item_id, r.reason) for r in m.items.collect()}
    assert rows[3] == ("1", None) and rows[4] == ("2", None) and rows[5][0] is None and rows[6][0] == "TOTAL"
    assert {(r.row_idx, r.col_idx): r.value for r in m.cells.where("row_idx > 1 AND col_idx BETWEEN 7 AND 10").collect()} == {
        (3, 7): "1000", (3, 8): "12000", (3, 9): "2000", (3, 10): "24000", (4, 7): "500", (4, 8): "6000"}


def test_checks_read_line_texts(spark, tmp_path):
    """Filters on the quote lines read their columns; they don't build the texts again."""
    spark.createDataFrame([(1, "large ring", "Brand#1", "LARGE", 5)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "S1")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(17, 1, 1, 1, 5.0, 50.0, "N", "O", None), (18, 1, 1, 2, 5.0, 60.0, "N", "O", None), (29, 1, 1, 3, 5.0, 60.0, "N", "O", None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    valid = Inputs(spark, str(tmp_path)).chain.valid
    assert {(r.source_row, r.description, r.unit_price) for r in valid.collect()} == {
        (1, "item large ring 5cm", 10.0), (2, "large ring 5cm 75g", 12.0)}
    filters = [x for x in valid._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("l_orderkey" in x and "% 17" in x for x in filters), filters
