"""Sheet cells derived from the quote lines: one file per request.

Sheet ``Dados`` holds the quotes of the request under one of six header styles; sheet
``Resumo`` holds a line of our own result columns, which must not look like input. The
matrix sheets hold a column pair per supplier.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Header styles by layout number; layout 3 is positional, 5 names description and price only.
HEADERS = (
    ("ID do item", "Descrição", "Quantidade", "Unidade", "Fornecedor", "Preço Unitário",
     "Preço Total", "Condições de Entrega", "Dias Pagamento", "Frete", "Pedido Mínimo", "Observação"),
    ("Item Code", "Product Description", "Qty", "UOM", "Vendor", "Unit Price", "Total Price",
     "Lead Time", "Payment Terms", "Freight", "MOQ", "Notes"),
    ("Codigo_Cotacao", "Nome_Produto", "Quantidade", "Unidade", "Fornecedor", "Preco_Unitario",
     "Valor Total", "Condicoes_Entrega", "Prazo Pagamento", "Frete Incluso", "Pedido Minimo",
     "Similaridade (%)"),
    ("Campo A", "Campo B", "Campo C", "Campo D", "Campo E", "Campo F", "Campo G", "Campo H",
     "Campo I", "Campo J", "Campo K", "Campo L"),
    ("ID", "Descrição do produto cotado", "Qtde", "Und", "Nome do Fornecedor (empresa)",
     "Valor unitário em reais", "Total geral da linha", "Prazo de entrega", "Pagamento", "Frete",
     "Pedido mínimo", "Fornecedor X - Preço"),
    ("Jj", "Descrição", "Jjj", "Jjjj", "Jjjjj", "Preço", "Jjjjjj", "Jjjjjjj", "Jjjjjjjj", "Jjjjjjjjj", "Jjjjjjjjjj", "Jjjjjjjjjjj"),
)
HEADER_ROW = (0, 0, 0, 2, 1, 0)
FIRST_ROW = (1, 1, 1, 3, 3, 1)

PRICE_PLAIN = ("concat(cast(cast(floor(price_cents / 100.0) AS bigint) AS varchar(20)), {sep}, "
               "lpad(cast(price_cents % 100 AS varchar(20)), 2, '0'))")
PRICE = (f"CASE WHEN layout IN (0, 3) THEN concat('R$ ', {PRICE_PLAIN.format(sep=chr(39) + ',' + chr(39))}) "
         f"ELSE {PRICE_PLAIN.format(sep=chr(39) + '.' + chr(39))} END")
QUANTITY = "cast(cast(quantity AS bigint) AS varchar(20))"
TOTAL = "cast(cast(floor(total_price) AS bigint) AS varchar(20))"

# Cell text by column; layout 3 has unit and quantity swapped.
FIELDS = (
    "CASE WHEN layout = 2 THEN quote_code ELSE item_id END", "description",
    f"CASE WHEN layout = 3 THEN unit ELSE {QUANTITY} END",
    f"CASE WHEN layout = 3 THEN {QUANTITY} ELSE unit END", "supplier", PRICE, TOTAL, "delivery",
    "payment", "freight", "min_order", "observation",
)
WIDTH = len(FIELDS)


def _pick(values, layout: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), layout + 1)


def sheet_cells(lines: DataFrame) -> DataFrame:
    """Cells of both sheets of every file; empty cells are null."""
    layout = F.pmod(F.split("rfq_id", "-")[1].cast("int"), F.lit(6)).cast("int")
    lines = lines.withColumn("layout", layout)
    data = lines.select(
        F.col("rfq_id").alias("file"), F.lit("Dados").alias("sheet"),
        (F.col("source_row") - 1 + _pick(FIRST_ROW, F.col("layout"))).alias("row_idx"),
        F.posexplode(F.array(*[F.expr(f) for f in FIELDS])).alias("col_idx", "value"))
    files = lines.groupBy(F.col("rfq_id").alias("file"), "layout").agg(F.count(F.lit(1)).alias("n"))
    styles = F.array(*[F.array(*[F.lit(h) for h in style]) for style in HEADERS])
    headers = files.select(
        "file", F.lit("Dados").alias("sheet"),
        _pick(HEADER_ROW, F.col("layout")).cast("bigint").alias("row_idx"),
        F.posexplode(F.element_at(styles, F.col("layout") + 1)).alias("col_idx", "value"))
    title = files.where("layout IN (3, 4)").select(
        "file", F.lit("Dados").alias("sheet"), F.lit(0).cast("bigint").alias("row_idx"),
        F.lit(0).alias("col_idx"), F.lit("MAPA COMPARATIVO").alias("value"))
    summary = files.select("file", F.lit("Resumo").alias("sheet"), F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Fornecedor").alias("value")),
        F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.lit(1).alias("col_idx"), F.lit("Score Preço").alias("value")),
        F.struct(F.lit(1).cast("bigint").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Todos").alias("value")),
        F.struct(F.lit(1).cast("bigint").alias("row_idx"), F.lit(1).alias("col_idx"), F.col("n").cast("string").alias("value")),
    )).alias("c")).select("file", "sheet", "c.row_idx", "c.col_idx", "c.value")
    return data.unionByName(headers).unionByName(title).unionByName(summary)


def sheet_manifest(lines: DataFrame) -> DataFrame:
    """Every sheet of every file: ``readable`` is false where the reader failed.

    Files of layout 2 have an empty sheet besides; those of layout 4 come with a second file
    that cannot be read at all.
    """
    files = lines.select(F.col("rfq_id").alias("file"), F.pmod(
        F.split("rfq_id", "-")[1].cast("int"), F.lit(6)).alias("layout")).distinct()
    sheet = lambda f, name, ok: F.struct(f.alias("file"), F.lit(name).alias("sheet"), F.lit(ok).alias("readable"))
    own = F.col("file")
    sheets_ = F.array(sheet(own, "Dados", True), sheet(own, "Resumo", True),
                      F.when(F.col("layout") == 2, sheet(own, "Vazia", True)),
                      F.when(F.col("layout") == 4, sheet(F.concat("file", F.lit("-quebrado")), "Plan1", False)))
    return files.select(F.explode(F.array_compact(sheets_)).alias("s")).select("s.*")


def wanted_sheets(manifest: DataFrame) -> DataFrame:
    """Sheets that callers ask for by name: that of the data, in files whose name ends in 3, and one
    that does not exist, in those that end in 7."""
    files = manifest.where("readable").select("file").distinct()
    return files.where("file LIKE '%3' OR file LIKE '%7'").select(
        "file", F.when(F.col("file").endswith("3"), "Dados").otherwise("Planilha1").alias("sheet"))


def _union(*selects: str) -> str:
    return "\nUNION ALL ".join(selects)


_LINES = "(SELECT *, cast(split_part(rfq_id, '-', 2) AS integer) % 6 AS layout FROM lines)"
_FILES = f"(SELECT rfq_id, layout, count(*) AS n FROM {_LINES} GROUP BY rfq_id, layout)"


def _case(values) -> str:
    return "CASE layout " + " ".join(f"WHEN {n} THEN {v!r}" for n, v in enumerate(values)) + " END"


CELLS_SQL = _union(
    *[f"SELECT rfq_id AS file, 'Dados' AS sheet, source_row - 1 + {_case(FIRST_ROW)} AS row_idx, {n} AS col_idx, "
      f"{field} AS value FROM {_LINES}" for n, field in enumerate(FIELDS)],
    *[f"SELECT rfq_id, 'Dados', {_case(HEADER_ROW)}, {n}, {_case([s[n] for s in HEADERS])} FROM {_FILES}"
      for n in range(WIDTH)],
    f"SELECT rfq_id, 'Dados', 0, 0, 'MAPA COMPARATIVO' FROM {_FILES} WHERE layout IN (3, 4)",
    f"SELECT rfq_id, 'Resumo', 0, 0, 'Fornecedor' FROM {_FILES}",
    f"SELECT rfq_id, 'Resumo', 0, 1, 'Score Preço' FROM {_FILES}",
    f"SELECT rfq_id, 'Resumo', 1, 0, 'Todos' FROM {_FILES}",
    f"SELECT rfq_id, 'Resumo', 1, 1, cast(n AS varchar) FROM {_FILES}")


MANIFEST_SQL = _union(
    f"SELECT rfq_id AS file, 'Dados' AS sheet, TRUE AS readable FROM {_FILES}", f"SELECT rfq_id, 'Resumo', TRUE FROM {_FILES}",
    f"SELECT rfq_id, 'Vazia', TRUE FROM {_FILES} WHERE layout = 2",
    f"SELECT concat(rfq_id, '-quebrado'), 'Plan1', FALSE FROM {_FILES} WHERE layout = 4")


# --- price matrix --------------------------------------------------------------------
# Row 0: supplier labels; row 1: headers; item with part number p in row p + 2; then a
# nameless row and a total. Column pairs: supplier s at 5 + 2s, then the first supplier of
# the request again (its final round), baseline, target. Suppliers with even numbers have
# no header over the unit price.

LEAD_HEADERS = ("ID", "Local", "Velocidade", "Unidade", "Qtde. (meses)")
LEAD_FIELDS = ("item_id", "CASE WHEN part % 50 = 7 THEN NULL ELSE text END", "'100 Mbps'",
               "CASE WHEN part % 3 = 0 THEN NULL ELSE 'UN' END",
               "CASE WHEN part % 40 = 9 THEN 'n/d' ELSE cast(10 + (part % 5) * 5 AS varchar(20)) END")
_PRICED = "min(CASE WHEN price_cents > 0 THEN price_cents END)"


def matrix_cells(pairs: DataFrame, texts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Cells of a matrix sheet per request, from the cheapest price per item and supplier.

    ``pairs`` (rfq_id, part, supplier_id, low, high) has a row for each item and supplier; the ``texts`` of items
    (rfq_id, part, item_id, text) and the names of ``suppliers`` (supplier_id, supplier) are joined to their own cells.
    """
    prices = pairs.withColumnRenamed("low", "price")
    names = pairs.select("rfq_id", "supplier_id").distinct().join(suppliers, "supplier_id")
    ends = pairs.groupBy("rfq_id").agg(F.max("supplier_id").alias("s"), F.max("part").alias("p"),
                                       F.min("supplier_id").alias("first_id"))
    spelled = suppliers.groupBy("supplier_id").agg(F.min("supplier").alias("first"))
    ends = ends.join(spelled.withColumnRenamed("supplier_id", "first_id"), "first_id")
    items = (pairs.groupBy("rfq_id", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
             .join(texts, ["rfq_id", "part"]).join(ends.select("rfq_id", "s"), "rfq_id"))

    def cells(df: DataFrame, *triples: tuple) -> DataFrame:
        made = F.array(*[F.struct(r.cast("bigint").alias("row_idx"), c.cast("int").alias("col_idx"),
                                  v.cast("string").alias("value")) for r, c, v in triples])
        return df.select(F.col("rfq_id").alias("file"), F.lit("Matriz").alias("sheet"),
                         F.explode(made).alias("c")).select("file", "sheet", "c.*")

    at, one, zero = 5 + 2 * F.col("supplier_id"), F.lit(1), F.lit(0)
    row, end = F.col("part") + 2, 7 + 2 * F.col("s")
    unit, total = F.lit("Unitário"), F.lit("Total")
    low, high = F.col("low"), F.col("high")
    return cells(prices, (row, at, F.col("price")), (row, at + 1, F.col("price") * 12)).unionByName(
        cells(items, *[(row, F.lit(n), F.expr(f)) for n, f in enumerate(LEAD_FIELDS)],
              (row, end, low), (row, end + 1, low * 12), (row, end + 2, high),
              (row, end + 3, high * 12), (row, end + 4, low), (row, end + 5, low * 12))).unionByName(
        cells(names, (zero, at, F.col("supplier")), (one, at + 1, total),
              (one, at, F.when(F.col("supplier_id") % 2 == 1, unit)))).unionByName(
        cells(ends, *[(one, F.lit(n), F.lit(h)) for n, h in enumerate(LEAD_HEADERS)],
              (zero, end, F.col("first")), (zero, end + 2, F.lit("BASELINE")), (zero, end + 4, F.lit("TARGET")),
              *[(one, end + 2 * n, unit) for n in range(3)], *[(one, end + 1 + 2 * n, total) for n in range(3)],
              (F.col("p") + 3, one, F.lit("sem código")), (F.col("p") + 4, zero, F.lit("TOTAL"))))


_PRICES = f"(SELECT rfq_id, cast(item_id AS bigint) AS part, supplier_id, {_PRICED} AS price FROM lines GROUP BY ALL)"
_ENDS = ("(SELECT rfq_id, max(supplier_id) AS s, max(cast(item_id AS bigint)) AS p, "
         "arg_min(upper(supplier), supplier_id) AS first FROM lines GROUP BY rfq_id)")
_ITEMS = f"""(SELECT * FROM (SELECT rfq_id, cast(item_id AS bigint) AS part, item_id, req_description AS text, {_PRICED} AS low,
    max(price_cents) AS high FROM lines GROUP BY ALL) JOIN (SELECT rfq_id, s FROM {_ENDS}) USING (rfq_id))"""
_NAMES = "(SELECT DISTINCT rfq_id, supplier_id, upper(supplier) AS supplier FROM lines)"


def _cell(source: str, row: str, col: str, value: str) -> str:
    return (f"SELECT rfq_id AS file, 'Matriz' AS sheet, {row} AS row_idx, {col} AS col_idx, "
            f"cast({value} AS varchar) AS value FROM {source}")


_AT, _END = "5 + 2 * supplier_id", "7 + 2 * s"
MATRIX_SQL = _union(
    _cell(_PRICES, "part + 2", _AT, "price"), _cell(_PRICES, "part + 2", "6 + 2 * supplier_id", "price * 12"),
    *[_cell(_ITEMS, "part + 2", str(n), f) for n, f in enumerate(LEAD_FIELDS)],
    *[_cell(_ITEMS, "part + 2", f"{_END} + {n}", v) for n, v in enumerate(
        ("low", "low * 12", "high", "high * 12", "low", "low * 12"))],
    _cell(_NAMES, "0", _AT, "supplier"), _cell(_NAMES, "1", "6 + 2 * supplier_id", "'Total'"),
    _cell(_NAMES, "1", _AT, "CASE WHEN supplier_id % 2 = 1 THEN 'Unitário' END"),
    *[_cell(_ENDS, "1", str(n), f"'{h}'") for n, h in enumerate(LEAD_HEADERS)],
    *[_cell(_ENDS, "0", f"{_END} + {2 * n}", v) for n, v in enumerate(("first", "'BASELINE'", "'TARGET'"))],
    *[_cell(_ENDS, "1", f"{_END} + {n}", v) for n, v in enumerate(("'Unitário'", "'Total'") * 3)],
    _cell(_ENDS, "p + 3", "1", "'sem código'"), _cell(_ENDS, "p + 4", "0", "'TOTAL'"))
