"""Sheets to typed quotes: each row assembled once and read by the fixed layout of its sheet.

A layout is one row for each sheet that is read: where its header stands, which column holds
which concept, and for a price matrix the columns of the proposals. Rows of one sheet,
however many, meet it in blocks.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidframe.functions.numbers import parse_locale_number
from bidframe.functions.text import clean_text, clean_unit
from bidframe.operators import identity as ident, matrix as mx, quality
from bidframe.operators.schema_match import SHEET
from bidframe.operators.skew import HotGroups

#: Rows of a sheet that meet one copy of its layout.
BLOCK_ROWS = 100_000
#: A sheet has fewer columns than this.
MOST_COLUMNS = 1 << 20

#: Quote columns by concept.
QUOTE_COLUMNS = {
    "ID": "item_id", "DESCRIPTION": "description", "QUANTITY": "quantity", "UNIT": "unit", "SUPPLIER": "supplier",
    "UNIT_PRICE": "unit_price", "TOTAL_PRICE": "total_price", "PAYMENT_DAYS": "payment", "DELIVERY_DAYS": "delivery",
    "MIN_ORDER": "min_order", "FREIGHT": "freight", "PROPOSAL_VALIDITY": "validity", "OBSERVATION": "observation",
    "CATEGORY": "category", "CURRENCY": "currency", "STATUS": "status", "QUOTE_DATE": "quote_date"}
NUMBERS = ("quantity", "unit_price", "total_price")


def sheet_layouts(chosen: DataFrame, header_rows: DataFrame, sizes: DataFrame, mapped: DataFrame, columns: DataFrame,
                  price_columns: DataFrame, labels: mx.MatrixLabels = mx.MatrixLabels()) -> DataFrame:
    """One row for each chosen sheet: header_row, rows, columns (concept to place), id_from_code, is_matrix
    and proposals.

    ``columns`` are the detected ones; an id column that is a quote code there is marked. Maps and lists are
    as long as a sheet is wide.
    """
    placed = mapped.where("col_idx IS NOT NULL")
    maps = placed.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("concept", "col_idx"))).alias("columns"))
    codes = (placed.where("concept = 'ID'").drop("concept", "problem")
             .join(columns.where("concept = 'QUOTE_ID'").select(*SHEET, "col_idx"), [*SHEET, "col_idx"])
             .select(*SHEET, F.lit(True).alias("id_from_code")))
    proposals = mx.tag_final_round(price_columns, labels).groupBy(*SHEET).agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "supplier"))).alias("proposals"))
    matrices = mx.detect_matrix(price_columns, labels).where("is_matrix").select(*SHEET, "is_matrix")
    out = (chosen.select(*SHEET).join(header_rows.select(*SHEET, "header_row"), SHEET).join(sizes, SHEET)
           .join(maps, SHEET, "left").join(codes, SHEET, "left").join(matrices, SHEET, "left")
           .join(proposals, SHEET, "left"))
    return (out.withColumn("columns", F.coalesce("columns", F.create_map().cast("map<string,int>")))
            .withColumn("id_from_code", F.coalesce("id_from_code", F.lit(False)))
            .withColumn("is_matrix", F.coalesce("is_matrix", F.lit(False)))
            .withColumn("id_absent", ~F.col("is_matrix") & ~F.map_contains_key("columns", "ID")))


def sheet_sizes(cells: DataFrame) -> DataFrame:
    """Rows of every sheet down to its last cell, empty ones included."""
    return cells.groupBy(*SHEET).agg((F.max("row_idx") + 1).alias("rows"))


def sheet_rows(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """Every row below the header that holds a value, as a list of its cells, with its sheet's layout.

    The rows are put together by their own key, so a very long sheet is no large group; its
    layout is copied once for each BLOCK_ROWS rows.
    """
    block = F.floor(F.col("row_idx") / BLOCK_ROWS).cast("int")
    rows = (cells.where("value IS NOT NULL").groupBy(*SHEET, "row_idx").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "value"))).alias("cells")).withColumn("block", block))
    last = F.floor(F.greatest(F.col("rows") - 1, F.lit(0)) / BLOCK_ROWS).cast("int")
    copies = layouts.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    return rows.join(copies, [*SHEET, "block"]).where("row_idx > header_row").drop("block")


def cell_at(place: Column) -> Column:
    """The value in a column of the row, null where there is none."""
    return F.get(F.filter("cells", lambda c: c["col_idx"] == place), F.lit(0))["value"]


def _typed(quotes: DataFrame) -> DataFrame:
    text = [c for c in QUOTE_COLUMNS.values() if c not in (*NUMBERS, "unit")]
    return quotes.withColumns({**{c: clean_text(F.col(c)) for c in text}, "unit": clean_unit(F.col("unit")),
                               **{c: parse_locale_number(F.col(c)) for c in NUMBERS}})


def table_quotes(rows: DataFrame) -> DataFrame:
    """Typed quotes of the tabular sheets, one for each row with a value in some mapped column."""
    placed = {name: cell_at(F.element_at("columns", F.lit(concept))) for concept, name in QUOTE_COLUMNS.items()}
    quotes = rows.where("NOT is_matrix").select(
        *SHEET, (F.col("row_idx") + 1).alias("source_row"), (F.col("row_idx") + 1).alias("sheet_row"), "id_from_code", "id_absent",
        *[v.alias(k) for k, v in placed.items()])
    filled = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in placed])
    return _typed(quotes.where(filled))


def matrix_items(rows: DataFrame) -> DataFrame:
    """Rows of the price matrices with their leading cells cleaned, and why a row is no item."""
    lead = {n: cell_at(F.lit(i)) for i, n in enumerate(("item_id", "description", "third", "unit", "quantity"))}
    items = rows.where("is_matrix").select(
        *SHEET, "row_idx", "cells", "proposals",
        *[(parse_locale_number(v) if n == "quantity" else clean_text(v)).alias(n) for n, v in lead.items()])
    return mx.with_reason(items)


def matrix_quotes(items: DataFrame) -> DataFrame:
    """One typed quote for each item row and proposal column with a readable price.

    ``source_row`` tells the quotes of one ``sheet_row`` apart, in the order of the columns.
    """
    priced = (items.where("reason IS NULL").withColumn("p", F.explode("proposals"))
              .withColumn("unit_price", parse_locale_number(cell_at(F.col("p.col_idx"))))
              .where("unit_price IS NOT NULL")
              .withColumn("total_price", parse_locale_number(cell_at(F.col("p.col_idx") + 1))))
    known = ("item_id", "description", "quantity", "unit_price", "total_price")
    return priced.select(
        *SHEET, ((F.col("row_idx") + 1) * MOST_COLUMNS + F.col("p.col_idx")).alias("source_row"),
        (F.col("row_idx") + 1).alias("sheet_row"), F.lit(False).alias("id_from_code"), F.lit(False).alias("id_absent"), *known, F.upper("unit").alias("unit"), F.col("p.supplier").alias("supplier"),
        *[F.lit(None).cast("string").alias(c) for c in QUOTE_COLUMNS.values()
          if c not in (*known, "unit", "supplier")])


def blank_counts(layouts: DataFrame, rows: DataFrame) -> DataFrame:
    """Empty rows below the header of each tabular sheet that has some."""
    filled = rows.where("NOT is_matrix").groupBy(*SHEET).agg(F.count(F.lit(1)).alias("filled"))
    below = F.col("rows") - 1 - F.col("header_row") - F.coalesce("filled", F.lit(0))
    return (layouts.where("NOT is_matrix").join(filled, SHEET, "left")
            .select(*SHEET, F.greatest(below, F.lit(0)).alias("blank_rows")).where("blank_rows > 0"))


# --- item ids ------------------------------------------------------------------------


def group_missing_ids(quotes: DataFrame) -> DataFrame:
    """Sheets without any id column: items are told apart by description and unit."""
    key = ident.composite_item_key(F.col("description"), F.col("unit"))
    return quotes.withColumn("item_id", F.when(F.col("id_absent"), key).otherwise(F.col("item_id")))


def code_verdicts(valid: DataFrame) -> DataFrame:
    """Requests whose ids are quote codes, with ``unreliable``."""
    coded = valid.where("id_from_code").withColumn("quote_code", F.col("item_id"))
    return ident.quote_id_reliability(coded).select("rfq_id", "unreliable")


def ids_from_codes(valid: DataFrame, verdicts: DataFrame, hot_code: HotGroups | None = None) -> DataFrame:
    """Valid quotes with the ids of code columns repaired, and ``id_note``: ``ids`` (replaced by description and
    unit), ``codes`` (suffixed by the row) or null.

    Codes with very many rows (``hot_code``) are joined in salted parts.
    """
    coded = valid.where("id_from_code").withColumn("quote_code", F.col("item_id"))
    suffixed = (ident.suffix_repeated_codes(coded, hot_code)
                .withColumn("repeated", ~F.col("item_id").eqNullSafe(F.col("quote_code"))))
    judged = suffixed.join(verdicts, "rfq_id")
    out = judged.withColumn("item_id", F.when(F.col("unreliable"), ident.composite_item_key(
        F.col("description"), F.col("unit"))).otherwise(F.col("item_id"))).withColumn(
        "id_note", F.when(F.col("unreliable"), "ids").when(F.col("repeated"), "codes"))
    plain = valid.where("NOT id_from_code").withColumn("id_note", F.when(F.col("id_absent"), "absent"))
    return plain.unionByName(out.select(*plain.columns))


# --- what keeps a file from being read -----------------------------------------------

# Titles of what keeps a file from being read, by code, and the hints given with all.
FILE_PROBLEMS = {
    "aba_inexistente": "Aba não encontrada",
    "nenhuma_aba_analisavel": "Nenhuma aba analisável",
    "colunas_nao_reconhecidas": "Colunas obrigatórias não reconhecidas",
    "coluna_ambigua": "Coluna ambígua",
    "posicao_invalida": "Mapeamento manual inválido",
    "coluna_manual_inexistente": "Mapeamento manual inválido",
    "sem_propostas_validas": "Nenhuma proposta válida",
    "ids_conflitantes": "Identificadores de item conflitantes",
}
GENERAL_HINTS = (
    "Cada linha deve representar um item cotado por um fornecedor.",
    "Inclua uma linha de cabeçalho com nomes como Descrição, Quantidade, Unidade, Fornecedor e Preço Unitário.",
    "Se a planilha tiver várias abas, informe o nome da aba correta no campo \"Aba\".",
)


def sheet_choice(manifest: DataFrame, chosen: DataFrame, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The sheet read of each file, and the files whose asked one does not exist.

    ``manifest``: every sheet of every file, empty ones too. ``chosen``: the best sheet of each
    file by detection. ``wanted``: the sheets that callers ask for (file, sheet); they take its place.
    """
    if wanted is None:
        return chosen.select(*SHEET), chosen.select(*SHEET).limit(0)
    known = wanted.join(manifest.select(*SHEET), SHEET, "left_semi")
    unknown = wanted.join(manifest.select(*SHEET), SHEET, "left_anti")
    return (known.select(*SHEET).unionByName(chosen.join(wanted.select("file"), "file", "left_anti").select(*SHEET)),
            unknown.select(*SHEET))


def conflicting_files(valid: DataFrame) -> DataFrame:
    """Requests in which one id stands for several descriptions or units: ``rfq_id``, the first ids."""
    found = quality.item_conflicts(valid)
    first = found.select("rfq_id", "item_id").groupBy("rfq_id").agg(
        F.count(F.lit(1)).alias("conflicts"), F.min("item_id").alias("first_id"))
    return first


# Names of the concepts in messages.
CONCEPT_LABELS = {
    "ID": "identificador do item", "DESCRIPTION": "descrição do item", "QUANTITY": "quantidade", "UNIT": "unidade",
    "UNIT_PRICE": "preço unitário", "TOTAL_PRICE": "preço total", "SUPPLIER": "fornecedor",
    "SUPPLIER_ID": "código do fornecedor", "QUOTE_ID": "código da cotação", "CURRENCY": "moeda",
    "CATEGORY": "categoria", "QUOTE_DATE": "data da cotação", "PAYMENT_DAYS": "prazo de pagamento",
    "DELIVERY_DAYS": "prazo de entrega", "FREIGHT": "frete", "MIN_ORDER": "pedido mínimo",
    "PROPOSAL_VALIDITY": "validade da proposta", "STATUS": "status", "OBSERVATION": "observação"}


def concept_label(concept: Column) -> Column:
    """Name of a concept in messages; one without a name stands for itself."""
    names = F.create_map(*[F.lit(x) for pair in CONCEPT_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, concept), concept)


def nearest(headers: DataFrame, missing: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` headers of a sheet that score best for each concept it lacks; ties go by place.

    A sheet has few headers, so each of its missing concepts meets all of them.
    """
    flags = [c for c in scores.columns if c.startswith("ctx_")]
    met = (headers.join(scores, ["norm", *flags]).join(missing, [*SHEET, "concept"], "left_semi"))
    place = F.row_number().over(Window.partitionBy(*SHEET, "concept").orderBy(F.desc("score"), "col_idx"))
    return (met.withColumn("place", place).where(F.col("place") <= k)
            .select(*SHEET, "concept", "place", "header", "score", "alias"))
