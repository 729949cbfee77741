"""Sheets to quotes, problems and recommendations on small workbooks."""
import pytest
from pyspark.sql import SparkSession, functions as F

from bidframe.operators import sheet_import as si
from bidframe.plans.from_sheets import SheetImport

CELLS = "file string, sheet string, row_idx long, col_idx int, value string"
COMPLETE = ("ID", "Descrição", "Quantidade", "Unidade", "Fornecedor", "Preço Unitário")


@pytest.fixture(scope="module")
def spark():
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


def cells(spark, books):
    rows = [(file, sheet, r, c, None if v is None else str(v)) for file, sheets in books.items()
            for sheet, lines in sheets.items() for r, line in enumerate(lines) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, CELLS).repartition(3)


BOOKS = {
    "tables": {"Dados": [
        (*COMPLETE, "Dias Pagamento", "Prazo Entrega", "Frete"),
        ("001", "Caneta azul ponta fina", 10, "Caixa", "Fornecedor A", "R$ 10,50", "30 dias", "5 dias", "Incluso"),
        ("001", "Caneta azul ponta fina", 10, "Caixa", "Fornecedor B", "11,75", "45 dias", "8 dias", "Não incluso"),
        (None,) * 9,
        ("001", "Caneta azul ponta fina", 10, "Caixa", "FORNECEDOR  a", "12", None, None, None),
        ("002", "Papel A4", 0, "Caixa", "Fornecedor B", "1", None, None, None)]},
    "totals": {"Dados": [(*COMPLETE, "Preço Total"), ("1", "Item A", 10, "UN", "Fornecedor A", "10,00", "50,00")]},
    "matrix": {"Mapa": [
        (None, None, "Cotação") + (None,) * 8,
        (None,) * 5 + ("PROPOSTAS INICIAIS",) + (None,) * 5,
        (None,) * 5 + ("Fornecedor A", None, "Fornecedor B", None, "Fornecedor A", None),
        ("ID", "Local", "Velocidade", "Unidade", "Qtde. (meses)", "Unitário", "Total", "", "Total", "Unitário", "Total"),
        ("1", "Escritório", "100 Mbps", "UN", 12, 100, 1200, 90, 1080, 80, 960),
        (None, "sem código") + (None,) * 9,
        ("TOTAL",) + (None,) * 4 + (100, 1200, 90, 1080, 80, 960)]},
    "codes": {"Export": [
        ("ID_Fornecedor", "Fornecedor", "Codigo_Cotacao", "Nome_Produto", "Quantidade", "Unidade", "Preco_Unitario", "Moeda",
         "Condicoes_Entrega"),
        ("FOR-1", "Fornecedor A", "COT-1", "Produto A", 5, "UN", "R$ 12,50", "BRL", "Entrega em 10 dias"),
        ("FOR-2", "Fornecedor B", "COT-1", "Produto B", 3, "UN", 20, "BRL", "Sob consulta"),
        ("FOR-3", "Fornecedor C", "COT-3", "Produto C", 1, "UN", None, "BRL", "Entrega imediata")]},
    "unique": {"Export": [
        ("ID_Fornecedor", "Fornecedor", "Codigo_Cotacao", "Nome_Produto", "Quantidade", "Unidade", "Preco_Unitario"),
        ("A", "Fornecedor A", "COT-1", "Produto A", 1, "UN", 12),
        ("B", "fornecedor a", "COT-2", "Produto A", 1, "un", 10),
        ("C", "Fornecedor B", "COT-3", "Produto A", 1, "UN", 11)]},
    "generic": {"Plan": [
        tuple(f"Campo {c}" for c in "ABCDEF"), ("SKU-001", "Caneta azul", "UN", 10, "Empresa A", 2.5),
        ("SKU-002", "Papel A4", "PCT", 5, "Empresa A", 18.0), ("SKU-003", "Grampeador", "UN", 2, "Empresa B", 25.0)]},
    "noise": {"Plan": [
        ("MAPA COMPARATIVO DE TESTE",) + (None,) * 5, ("Arquivo fictício",) + (None,) * 5,
        tuple(f"Campo {c}" for c in "ABCDEF"), ("ITEM-1", "Produto A", "UN", 2, "Fornecedor A", 10.0)]},
    "noids": {"Dados": [COMPLETE[1:], ("Papel A4", 5, "cx", "A", 10), ("Papel A4", 5, "CX", "B", 9),
                        ("Clipes", 1, "UN", "A", 1)]},
    "letters": {"Plan": [("A", "B", "C"), (1, 2, 3), (4, 5, 6)]},
    "worthless": {"Dados": [COMPLETE[1:], ("Item", 0, "UN", "A", 0)]},
    "clash": {"Dados": [COMPLETE, ("1", "Papel A4", 1, "UN", "A", 10), ("1", "Papel A3", 1, "UN", "B", 9)]},
    "asked": {"Dados": [COMPLETE, ("1", "Item", 1, "UN", "A", 10)], "Outra": [("x", "y"), ("1", "2")]},
    # Headers that say nothing: by the rules a data row may be taken for the header.
    "nameless": {"Plan": [tuple(f"Z{i}" for i in range(1, 7)), ("1", "Caneta", 2, "UN", "Empresa A", "R$ 3,50"),
                          ("2", "Papel", 5, "UN", "Empresa B", "R$ 7,50")]},
}


@pytest.fixture(scope="module")
def imported(spark):
    manifest = spark.createDataFrame(
        [(f, s, True) for f, sheets in BOOKS.items() for s in sheets] + [("tables", "Vazia", True), ("broken", "Plan1", False)],
        "file string, sheet string, readable boolean")
    wanted = spark.createDataFrame([("asked", "NaoExiste"), ("tables", "Dados")], "file string, sheet string")
    return SheetImport(cells(spark, BOOKS), manifest, wanted)


@pytest.fixture(scope="module")
def kept(imported):
    chain = imported.chain
    out = {}
    for r in chain.kept.join(chain.items.select("rfq_id", "item_id"), ["rfq_id", "item_id"]).collect():
        out.setdefault(r.rfq_id, []).append((r.item_id, r.supplier, r.description, r.quantity, r.unit, r.unit_price))
    return {k: sorted(v) for k, v in out.items()}


def test_tables_become_typed_quotes(kept):
    assert kept["tables"] == [("001", "Fornecedor A", "Caneta azul ponta fina", 10.0, "CAIXA", 10.5),
                              ("001", "Fornecedor B", "Caneta azul ponta fina", 10.0, "CAIXA", 11.75)]
    assert kept["generic"] == [("SKU-001", "Empresa A", "Caneta azul", 10.0, "UN", 2.5),
                               ("SKU-002", "Empresa A", "Papel A4", 5.0, "PCT", 18.0),
                               ("SKU-003", "Empresa B", "Grampeador", 2.0, "UN", 25.0)]
    assert kept["noise"] == [("ITEM-1", "Fornecedor A", "Produto A", 2.0, "UN", 10.0)]


def test_matrix_becomes_quotes(kept):
    assert kept["matrix"] == [("1", s, "Escritório", 12.0, "UN", p) for s, p in (
        ("Fornecedor A", 100.0), ("Fornecedor A (Final)", 80.0), ("Fornecedor B", 90.0))]


def test_codes_are_suffixed_or_replaced(kept):
    assert [r[0] for r in kept["codes"]] == ["COT-1-L2", "COT-1-L3"]
    assert kept["unique"] == [("Produto A [UN]", "Fornecedor A", "Produto A", 1.0, "UN", 10.0),
                              ("Produto A [UN]", "Fornecedor B", "Produto A", 1.0, "UN", 11.0)]


def test_missing_ids_group_by_description_and_unit(spark, imported, kept):
    assert [r[0] for r in kept["noids"]] == ["Clipes [UN]", "Papel A4 [CX]", "Papel A4 [CX]"]
    strict = SheetImport(cells(spark, {"noids": BOOKS["noids"]}), group_missing_ids=False)
    assert {(r.file, r.code) for r in strict.problems().collect()} == {("noids", "sem_propostas_validas")}


def test_problems_by_file(imported):
    found = {(r.file, r.code): r for r in imported.problems().collect()}
    assert {k for k in found if k[0] in ("broken", "asked", "worthless", "clash", "letters")} >= {
        ("broken", "nenhuma_aba_analisavel"), ("asked", "aba_inexistente"), ("worthless", "sem_propostas_validas"),
        ("clash", "ids_conflitantes")}
    assert not {f for f, _ in found} & {"tables", "totals", "matrix", "codes", "unique", "generic", "noise", "noids"}
    asked = found["asked", "aba_inexistente"]
    assert asked.sheets == ["Dados", "Outra"] and "NaoExiste" in asked.message and "Dados, Outra" in asked.hints[0]
    assert "preço unitário" in found["worthless", "sem_propostas_validas"].missing
    letters = [r for (f, _), r in found.items() if f == "letters"]
    assert letters and all(r.title and r.message and r.hints for r in letters)
    assert found["clash", "ids_conflitantes"].message.count(": 1.") == 1
    assert found["clash", "ids_conflitantes"].found["descrição do item"] == "Descrição"


def test_nameless_headers_never_give_quotes_without_saying_so(imported, kept):
    wrong = {r.code for r in imported.problems().where("file = 'nameless'").collect()}
    assert wrong or "nameless" in kept
    assert not (wrong & {"colunas_nao_reconhecidas", "coluna_ambigua"} and "nameless" in kept)


def test_notes_and_discards(imported):
    notes = {(r.rfq_id, r.kind): r.message for r in imported.notes().collect()}
    assert "(linhas: 2)" in notes["totals", "totals"]
    assert "(2, 3)" in notes["codes", "codes"] and "(linhas: 4)" in notes["codes", "invalid"]
    assert "quase único" in notes["unique", "ids"] and "agrupados por descrição" in notes["noids", "grouped"]
    gone = {(r.rfq_id, r.sheet_row, r.reason) for r in imported.discards().collect() if r.rfq_id in ("tables", "matrix", "unique")}
    assert gone == {
        ("tables", None, "1 linha(s) totalmente vazia(s) após o cabeçalho (ignoradas automaticamente)"),
        ("tables", 6, "quantidade inválida (0.0)"),
        ("tables", 5, "proposta duplicada para o mesmo item e fornecedor; mantida a menor cotação"),
        ("unique", 2, "proposta duplicada para o mesmo item e fornecedor; mantida a menor cotação"),
        ("matrix", 6, "linha sem identificador de item"), ("matrix", 7, "linha de total (ignorada de propósito)")}


def test_every_read_item_is_recommended(imported, kept):
    won = {(r.rfq_id, r.item_id): r.winner for r in imported.chain.recommendations.collect()}
    assert set(won) == {(f, r[0]) for f, rows in kept.items() for r in rows}
    assert won["tables", "001"] == "Fornecedor A" and won["unique", "Produto A [UN]"] == "Fornecedor A"
    assert won["matrix", "1"] == "Fornecedor A (Final)"


def test_manual_columns(spark):
    book = {"m": {"Dados": [("a", "b", "Quantidade", "Unidade", "Fornecedor", "valor final"),
                            ("9", "Caneta", 2, "UN", "Empresa A", "4,00")]}}
    manual = spark.createDataFrame([("m", "Dados", "DESCRIPTION", 1, None), ("m", "Dados", "UNIT_PRICE", None, "valor final"),
                                    ("m", "Dados", "ID", 0, None)],
                                   "file string, sheet string, concept string, position int, header string")
    got = SheetImport(cells(spark, book), manual=manual).quotes.collect()
    assert [(r.item_id, r.description, r.unit_price) for r in got] == [("9", "Caneta", 4.0)]
    wrong = manual.withColumn("position", F.when(F.col("concept") == "DESCRIPTION", 77)).withColumn(
        "header", F.when(F.col("concept") == "UNIT_PRICE", "não há"))
    found = {r.code: r for r in SheetImport(cells(spark, book), manual=wrong.where("concept <> 'ID'")).problems().collect()}
    assert "77" in found["posicao_invalida"].message and "6 coluna(s)" in found["posicao_invalida"].message
    assert "não há" in found["coluna_manual_inexistente"].message


def test_long_sheets_meet_their_layout_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(si, "BLOCK_ROWS", 7)
    book = {"long": {"Dados": [COMPLETE] + [(str(i), f"Item {i}", 1, "UN", "A", 5) for i in range(150)]}}
    got = SheetImport(cells(spark, book)).quotes
    assert got.count() == 150 and got.select("item_id").distinct().count() == 150


def test_nearest_headers_of_missing_concepts(spark):
    book = {"n": {"Dados": [("ID", "Descrição", "Quantidade", "Unidade", "Fornec", "Preço Unitário"),
                            ("1", "Caneta", "x", "y", "1234", "4,00")]}}
    imported = SheetImport(cells(spark, book))
    lost = {r.concept for r in imported.column_problems.collect()}
    near = imported.nearest_headers().collect()
    assert {r.concept for r in near} <= lost
    assert all(r.header == "Fornec" for r in near if r.place == 1 and r.concept == "SUPPLIER")


def test_no_sheets(spark):
    empty = SheetImport(spark.createDataFrame([], CELLS))
    assert empty.quotes.collect() == [] and empty.problems().collect() == []
    assert empty.chain.recommendations.collect() == []
