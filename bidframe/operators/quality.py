"""Row checks, discards, counts, violations and warnings."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidframe.functions.numbers import is_positive
from bidframe.functions.text import clean_text, strip
from bidframe.operators.identity import dropped_duplicates

REQUIRED = ("item_id", "description", "unit", "supplier", "quantity", "unit_price")
DUPLICATE_REASON = "proposta duplicada para o mesmo item e fornecedor; mantida a menor cotação"
BLANK_REASON = "linha totalmente vazia"


def is_invalid() -> Column:
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED])
    return missing | ~is_positive(F.col("quantity")) | ~is_positive(F.col("unit_price"))


def valid_rows(quotes: DataFrame) -> DataFrame:
    return quotes.where(~is_invalid())


def invalid_rows(quotes: DataFrame) -> DataFrame:
    return quotes.where(is_invalid())


def require_valid(quotes: DataFrame) -> DataFrame:
    """Strict mode: refuse the whole import when any row is invalid."""
    if not invalid_rows(quotes).isEmpty():
        raise ValueError("the quotes hold rows with missing or invalid required values")
    return quotes


def all_blank(columns) -> Column:
    return reduce(lambda a, b: a & b, [clean_text(F.col(c).cast("string")).isNull() for c in columns])


def blank_rows(rows: DataFrame, columns) -> DataFrame:
    return rows.where(all_blank(columns))


def drop_blank_rows(rows: DataFrame, columns) -> DataFrame:
    return rows.where(~all_blank(columns))


def reason_text() -> Column:
    """Why a row cannot be used, field by field; missing and wrong values differ."""
    quantity, price = F.col("quantity"), F.col("unit_price")

    def wrong(label, value):
        return F.concat(F.lit(f"{label} ("), value.cast("string"), F.lit(")"))

    reasons = F.concat_ws(
        "; ",
        F.when(quantity.isNull(), "quantidade ausente")
        .when(~is_positive(quantity), wrong("quantidade inválida", quantity)),
        F.when(price.isNull(), "preço unitário ausente")
        .when(~is_positive(price), wrong("preço unitário inválido", price)),
        F.when(F.col("description").isNull(), "descrição do item ausente"),
        F.when(F.col("unit").isNull(), "unidade ausente"),
        F.when(F.col("supplier").isNull(), "fornecedor ausente"))
    return F.when(reasons == "", "registro incompleto").otherwise(reasons)


def sheet_row(rows: DataFrame) -> Column:
    """Number of the line in its sheet: a column of its own where a line gives several quotes."""
    return F.col("sheet_row" if "sheet_row" in rows.columns else "source_row")


def _discard(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.select("rfq_id", sheet_row(rows).alias("sheet_row"), reason.alias("reason"),
                       F.coalesce(clean_text(F.col("description")), F.lit("")).alias("description"),
                       F.coalesce(clean_text(F.col("supplier")), F.lit("")).alias("supplier"))


def discard_reasons(quotes: DataFrame) -> DataFrame:
    return _discard(invalid_rows(quotes), reason_text())


def discards(quotes: DataFrame, valid: DataFrame, kept: DataFrame,
             blank: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """Every unused line with its reason: invalid, duplicate, blank and matrix lines."""
    out = discard_reasons(quotes).unionByName(
        _discard(dropped_duplicates(valid, kept), F.lit(DUPLICATE_REASON)))
    if blank is not None:
        out = out.unionByName(_discard(blank, F.lit(BLANK_REASON)))
    if other is not None:
        out = out.unionByName(other)
    return out


def total_mismatch(quotes: DataFrame) -> DataFrame:
    """Stated totals more than 1% (or 0.01) off quantity times price; prices stay."""
    expected = F.col("quantity") * F.col("unit_price")
    off = F.abs(F.col("total_price") - expected) > F.greatest(F.abs(expected) * 0.01, F.lit(0.01))
    return quotes.withColumn("expected_total", expected).where(off)


def row_counts(quotes: DataFrame, kept: DataFrame) -> DataFrame:
    """Physical, used and discarded lines per request; used counts deduplicated rows."""
    physical = quotes.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("physical_rows"))
    used = kept.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("used_rows"))
    return (physical.join(used, "rfq_id", "left")
            .withColumn("used_rows", F.coalesce("used_rows", F.lit(0)))
            .withColumn("discarded_rows", F.col("physical_rows") - F.col("used_rows")))


def item_conflicts(quotes: DataFrame) -> DataFrame:
    """Item ids that occur with different descriptions or units; null is a value."""

    def differs(column: str) -> Column:
        filled = F.count(column)
        return (F.min(column) != F.max(column)) | ((filled > 0) & (filled < F.count(F.lit(1))))

    return (quotes.groupBy("rfq_id", "item_id")
            .agg(F.coalesce(differs("description"), F.lit(False)).alias("description_differs"),
                 F.coalesce(differs("unit"), F.lit(False)).alias("unit_differs"))
            .where("description_differs OR unit_differs"))


# Violation codes with their titles.
VIOLATIONS = {
    "sem_itens": "Nenhum item encontrado",
    "sem_fornecedores": "Nenhum fornecedor identificado",
    "itens_sem_id": "Itens sem identificador",
    "ids_duplicados": "Identificadores duplicados",
    "fornecedor_sem_nome": "Fornecedor sem nome",
    "fornecedores_duplicados": "Fornecedores duplicados",
    "propostas_duplicadas": "Propostas duplicadas",
    "ids_inexistentes": "Itens fora do catálogo",
}


def trimmed(column: str) -> Column:
    return strip(F.coalesce(F.col(column), F.lit("")))


def unknown_items(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quoted ids that the catalogue of the request does not hold."""
    known = items.select("rfq_id", trimmed("item_id").alias("item_id")).distinct()
    quoted = (quotes.select("rfq_id", "supplier", trimmed("item_id").alias("item_id"))
              .groupBy("rfq_id", "supplier", "item_id").agg(F.count(F.lit(1)).alias("rows")))
    return quoted.join(known, ["rfq_id", "item_id"], "left_anti")


def validate_rfq(items: DataFrame, quotes: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row per broken rule of a request: code, title, supplier, item id, rows.

    ``suppliers`` is the supplier list of each request, one row per supplier.
    """
    def rule(code: str, df: DataFrame, supplier=None, item=None, rows=None) -> DataFrame:
        return df.select(
            "rfq_id", F.lit(code).alias("code"), F.lit(VIOLATIONS[code]).alias("title"),
            (supplier if supplier is not None else F.lit(None).cast("string")).alias("supplier"),
            (item if item is not None else F.lit(None).cast("string")).alias("item_id"),
            (rows if rows is not None else F.lit(1)).cast("bigint").alias("rows"))

    count = F.count(F.lit(1)).alias("rows")
    with_items = items.select("rfq_id").distinct()
    with_suppliers = suppliers.select("rfq_id").distinct()
    item_uses = items.groupBy("rfq_id", trimmed("item_id").alias("item_id")).agg(count)
    name_uses = suppliers.groupBy("rfq_id", trimmed("supplier").alias("supplier")).agg(count)
    quote_uses = (quotes.groupBy("rfq_id", "supplier", trimmed("item_id").alias("item_id"))
                  .agg(count))
    parts = [
        rule("sem_itens", with_suppliers.join(with_items, "rfq_id", "left_anti")),
        rule("sem_fornecedores", with_items.join(with_suppliers, "rfq_id", "left_anti")),
        rule("itens_sem_id", item_uses.where("item_id = ''"), rows=F.col("rows")),
        rule("ids_duplicados", item_uses.where("item_id <> '' AND rows > 1"),
             item=F.col("item_id"), rows=F.col("rows")),
        rule("fornecedor_sem_nome", name_uses.where("supplier = ''"), rows=F.col("rows")),
        rule("fornecedores_duplicados", name_uses.where("supplier <> '' AND rows > 1"),
             supplier=F.col("supplier"), rows=F.col("rows")),
        rule("propostas_duplicadas", quote_uses.where("rows > 1"),
             supplier=F.col("supplier"), item=F.col("item_id"), rows=F.col("rows")),
        rule("ids_inexistentes", unknown_items(items, quotes),
             supplier=F.col("supplier"), item=F.col("item_id"), rows=F.col("rows")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _with_first_rows(df: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """Rows per group and its first row numbers as text.

    The rank limit reaches the scan side, so only ``limit`` rows per group are gathered.
    """
    first = (df.select(*keys, "source_row", sheet_row(df).alias("_line"))
             .withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("source_row")))
             .where(F.col("_n") <= limit).groupBy(*keys)
             .agg(F.array_sort(F.collect_list("_line")).alias("_rows")))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    listed = F.array_join(F.transform("_rows", lambda r: r.cast("string")), ", ")
    return total.join(first, keys).select(*keys, "rows", listed.alias("first_rows"))


def import_warnings(quotes: DataFrame, valid: DataFrame, kept: DataFrame,
                    suffixed: DataFrame | None = None,
                    replaced: DataFrame | None = None) -> DataFrame:
    """Readable notes per request on totals, invalid rows, codes and duplicates.

    ``suffixed``: rows whose quote code got a row suffix; ``replaced``: requests whose
    ids were replaced by the composite key.
    """
    def note(kind: str, df: DataFrame, text: str, *args) -> DataFrame:
        return df.select("rfq_id", F.lit(kind).alias("kind"), F.col("rows"),
                         F.format_string(text, *args).alias("message"))

    rows = F.col("rows")
    totals = _with_first_rows(total_mismatch(quotes), ["rfq_id"])
    invalid = _with_first_rows(invalid_rows(quotes), ["rfq_id"])
    doubles = (dropped_duplicates(valid, kept).groupBy("rfq_id")
               .agg(F.count(F.lit(1)).alias("rows")))
    notes = [
        note("totals", totals, "%d total(is) informado(s) divergem de quantidade x preço unitário "
             "acima da tolerância de 1%% (linhas: %s).", rows, F.col("first_rows")),
        note("invalid", invalid, "%d registro(s) com dados obrigatórios inválidos foram ignorados "
             "(linhas: %s).", rows, F.col("first_rows")),
        note("duplicates", doubles, "%d proposta(s) duplicada(s) para o mesmo produto e fornecedor "
             "foram descartadas; foi mantida a menor cotação válida.", rows),
    ]
    if suffixed is not None:
        notes.append(note("codes", _with_first_rows(suffixed, ["rfq_id"]),
                          "Códigos de cotação repetidos receberam o sufixo da linha de origem "
                          "para manter cada proposta distinta (%s).", F.col("first_rows")))
    if replaced is not None:
        notes.append(note("ids", replaced.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("rows")),
                          "Código de cotação não foi usado como ID de item porque é quase único "
                          "por linha; os itens foram agrupados por descrição e unidade."))
    return reduce(DataFrame.unionByName, notes)
