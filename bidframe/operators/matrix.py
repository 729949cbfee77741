"""Sheets that hold one Unitário/Total column pair per supplier."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidframe.functions.numbers import parse_locale_number
from bidframe.functions.text import clean_text, strip

SHEET = ["file", "sheet"]
FIRST_PRICE_COLUMN = 5
FINAL_SUFFIX = " (Final)"
MATRIX_TYPE = "Matriz de equalização com propostas iniciais e finais"


@dataclass(frozen=True)
class MatrixLabels:
    """Labels above price columns that are references, not suppliers."""

    baseline: str = "BASELINE"
    adjusted_baseline: str = "BASELINE AJUSTADO"
    minimum_study: str = "ESTUDO DOS MÍNIMOS"
    target: str = "TARGET"

    def named(self) -> dict[str, str]:
        return {"baseline": self.baseline, "adjusted_baseline": self.adjusted_baseline,
                "minimum_study": self.minimum_study, "target": self.target}


def price_columns(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Unit-price columns with the label above them.

    A price column is headed unitário, or has no header and stands left of a total.
    """
    rows = header_rows.select(*SHEET, "header_row", "width")
    header = cells.select(*SHEET, F.col("row_idx").alias("header_row"), "col_idx",
                          F.lower(strip(F.col("value"))).alias("header"))
    # The labels' row is met by its own number, so that no other cell is read for them.
    above = rows.select(*SHEET, "header_row", (F.col("header_row") - 1).alias("row_idx"))
    label = (cells.join(above, [*SHEET, "row_idx"]).where("value IS NOT NULL")
             .select(*SHEET, "header_row", "col_idx", clean_text(F.col("value")).alias("label")))
    keys = [*SHEET, "header_row", "col_idx"]
    heads = header.join(rows, [*SHEET, "header_row"]).where((F.col("header_row") >= 1) & (F.col("col_idx") < F.col("width")))
    unit, total = F.col("header").isin("unitário", "unitario"), F.col("header") == "total"
    # A header tells of its own column, and a total of the one to its left too; other columns are never price columns.
    at = F.when(total, F.array(F.col("col_idx") - 1, "col_idx")).otherwise(F.array("col_idx"))
    own = F.col("at") == F.col("col_idx")
    marks = (heads.select(*SHEET, "header_row", "col_idx", unit.alias("unit"), (F.col("header") != "").alias("said"),
                          F.explode(at).alias("at")).where(F.col("at") >= FIRST_PRICE_COLUMN))
    found = marks.groupBy(*SHEET, "header_row", F.col("at").alias("col_idx")).agg(
        *[F.coalesce(F.bool_or(x), F.lit(False)).alias(n) for n, x in (
            ("unit", own & F.col("unit")), ("said", own & F.col("said")), ("before_total", ~own))])
    return (found.where(F.col("unit") | (~F.col("said") & F.col("before_total"))).select(*keys)
            .join(label, keys, "left").select(*keys, "label"))


def tag_final_round(columns: DataFrame, labels: MatrixLabels = MatrixLabels()) -> DataFrame:
    """Supplier of each proposal column; a repeated supplier is its final round."""
    repeat = F.row_number().over(Window.partitionBy(*SHEET, "label").orderBy("col_idx"))
    return (columns.where(F.col("label").isNotNull() & ~F.col("label").isin(*labels.named().values()))
            .withColumn("is_final", repeat > 1)
            .withColumn("supplier", F.when(F.col("is_final"), F.concat("label", F.lit(FINAL_SUFFIX)))
                        .otherwise(F.col("label"))))


def detect_matrix(columns: DataFrame, labels: MatrixLabels = MatrixLabels()) -> DataFrame:
    """Sheets with at least three price columns, two of them proposals."""
    proposal = F.col("label").isNotNull() & ~F.col("label").isin(*labels.named().values())
    return (columns.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("price_columns"), F.count(F.when(proposal, 1)).alias("proposals"))
        .withColumn("is_matrix", (F.col("price_columns") >= 3) & (F.col("proposals") >= 2)))


def item_rows(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Data rows with their five leading cells cleaned, and why a row is not an item."""
    def lead(i: int) -> Column:
        return F.max(F.when(F.col("col_idx") == i, F.col("value")))

    below = (cells.join(header_rows.select(*SHEET, "header_row"), SHEET)
             .where(F.col("row_idx") > F.col("header_row")).select(*SHEET, "row_idx", "col_idx", "value"))
    # Of the prices only the rows they stand in count; those many cells are reduced to them first.
    leading = F.col("col_idx") < FIRST_PRICE_COLUMN
    priced = below.where(~leading).select(*SHEET, "row_idx").distinct().select(
        *SHEET, "row_idx", F.lit(None).cast("int").alias("col_idx"), F.lit(None).cast("string").alias("value"))
    rows = (below.where(leading).unionByName(priced).groupBy(*SHEET, "row_idx").agg(
        clean_text(lead(0)).alias("item_id"), clean_text(lead(1)).alias("description"),
        clean_text(lead(2)).alias("third"), clean_text(lead(3)).alias("unit"),
        parse_locale_number(lead(4)).alias("quantity")))
    return with_reason(rows)


def with_reason(rows: DataFrame) -> DataFrame:
    """Rows of a matrix with ``reason`` why one is no item, and their unit from the first cell that has one."""
    absent = F.concat_ws("; ", F.when(F.col("description").isNull(), "descrição do item ausente"),
                         F.when(F.col("quantity").isNull(), "quantidade ausente"))
    reason = (F.when(F.col("item_id").isNull(), "linha sem identificador de item")
              .when(F.lower("item_id") == "total", "linha de total (ignorada de propósito)")
              .when(absent != "", absent))
    return rows.withColumn("reason", reason).withColumn(
        "unit", F.coalesce("unit", "third", F.lit("UN"))).drop("third")


def matrix_discards(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNotNull()).select(
        *SHEET, (F.col("row_idx") + 1).alias("sheet_row"), "reason",
        F.coalesce("description", F.lit("")).alias("description"), F.lit("").alias("supplier"))


def matrix_unpivot(cells: DataFrame, rows: DataFrame, proposals: DataFrame) -> DataFrame:
    """One quote per item row and proposal column with a readable price.

    The next cell, the total, comes along by shifting the columns, so the cells are
    joined to the price columns once. Only the numbers of cells are moved.
    """
    at = proposals.select(*SHEET, "col_idx", "supplier", F.lit(True).alias("is_unit"))
    beside = proposals.select(*SHEET, (F.col("col_idx") + 1).alias("col_idx"), "supplier", F.lit(False).alias("is_unit"))
    numbers = cells.select(*SHEET, "row_idx", "col_idx", parse_locale_number(F.col("value")).alias("number")).where(
        "number IS NOT NULL")
    # A repeated supplier's column pairs stay apart by the pair's first column.
    pair = F.when(F.col("is_unit"), F.col("col_idx")).otherwise(F.col("col_idx") - 1)
    priced = (numbers.join(at.unionByName(beside), [*SHEET, "col_idx"])
              .select(*SHEET, "row_idx", pair.alias("pair"), "supplier", "is_unit", "number")
              .groupBy(*SHEET, "row_idx", "pair", "supplier").agg(
        F.max(F.when(F.col("is_unit"), F.col("number"))).alias("unit_price"),
        F.max(F.when(~F.col("is_unit"), F.col("number"))).alias("total_price"))
        .where(F.col("unit_price").isNotNull()))
    return rows.where(F.col("reason").isNull()).join(priced, [*SHEET, "row_idx"]).select(
        *SHEET, "row_idx", "item_id", "description", "quantity", "unit", "supplier", "unit_price",
        "total_price")


def final_suppliers(proposals: DataFrame) -> DataFrame:
    """The supplier of the single final column of a sheet, where there is exactly one."""
    return (proposals.where("is_final").groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("n"), F.max("supplier").alias("final_supplier"),
        F.max("col_idx").alias("col_idx")).where("n = 1").drop("n"))


def matrix_reference(cells: DataFrame, rows: DataFrame, columns: DataFrame, proposals: DataFrame,
                     labels: MatrixLabels = MatrixLabels(), keep=lambda df: df) -> DataFrame:
    """Reference prices of each item row: the four references and the single final price.

    ``keep`` may write the few columns that hold them, so that their size is known before the cells meet them.
    """
    names = labels.named()
    first = columns.where(F.col("label").isin(*names.values())).groupBy(*SHEET, "label").agg(
        F.min("col_idx").alias("col_idx"))
    scenario = F.create_map(*[F.lit(x) for name, label in names.items() for x in (label, name)])
    wanted = (first.select(*SHEET, "col_idx", F.element_at(scenario, F.col("label")).alias("scenario"))
              .unionByName(final_suppliers(proposals).select(
                  *SHEET, "col_idx", F.lit("final_price").alias("scenario"))))
    wanted = keep(wanted)
    items = rows.where(F.col("item_id").isNotNull() & (F.lower("item_id") != "total")
                       & F.col("description").isNotNull())
    prices = (cells.join(wanted, [*SHEET, "col_idx"])
              .groupBy(*SHEET, "row_idx").pivot("scenario", [*names, "final_price"])
              .agg(F.first(parse_locale_number(F.col("value")))))
    return items.select(*SHEET, "row_idx", "item_id", "description", "quantity").join(
        prices, [*SHEET, "row_idx"], "left")


def matrix_metadata(proposals: DataFrame) -> DataFrame:
    """Type, proposal suppliers in column order, and the single final supplier."""
    listed = F.array_sort(F.collect_list(F.struct("col_idx", "supplier")))
    facts = proposals.groupBy(*SHEET).agg(
        F.transform(listed, lambda x: x["supplier"]).alias("suppliers"))
    return (facts.join(final_suppliers(proposals).drop("col_idx"), SHEET, "left")
            .withColumn("matrix_type", F.lit(MATRIX_TYPE)))
