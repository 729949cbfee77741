import os
import sys

import pytest
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bidframe.config import EngineConfig, SkewPolicy  # noqa: E402
from bidframe.functions import commercial, numbers, similarity, text  # noqa: E402
from bidframe.functions.phrases import scores as phrase_scores  # noqa: E402
from bidframe.operators.concepts import phrases  # noqa: E402
from bidframe.operators.skew import find_hot, number_rows, spread_join  # noqa: E402
from bidframe.operators.identity import no_hot  # noqa: E402
from bidframe.operators import matrix  # noqa: E402
from bidframe.plans.quotes import HotKeys, QuoteChain  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
            .config("spark.ui.enabled", "false").getOrCreate())


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_locale_numbers(spark):
    got = column(spark, ["R$ 1.234,56", "1,234.56", "25", "1.234", "-", None, "1-2"], numbers.parse_locale_number)
    assert got == [1234.56, 1234.56, 25.0, 1.234, None, None, None]


def test_days_and_terms(spark):
    assert column(spark, ["30", "Entrega imediata", "à vista", "30/60/90 dias", "10x"],
                  commercial.extract_days) == [30.0, 0.0, 0.0, 30.0, None]
    assert column(spark, ["CIF", "Frete por conta do fornecedor", "Não incluso", None],
                  commercial.freight_included) == [True, True, False, False]
    assert column(spark, ["Não há pedido mínimo", "0", "5 caixas", None],
                  commercial.no_min_order) == [True, True, False, True]


def test_normalize_text(spark):
    assert column(spark, ["Papel 1.5 cm", "15 cm", " Médio  UN ", "½ ㎝"], text.normalize_text) == [
        "papel 1.5 cm", "15 cm", "medio unidade", "1 2 cm"]


def test_similarity_helpers():
    assert similarity.lcs_length("abcde", "xacxe") == 3
    assert similarity._best_window("preco", "o preco total") == 100.0


def test_catalogue_size():
    assert len(phrases()) == len({a for _, a in phrases()}) == 282


def test_config_is_checked():
    with pytest.raises(ValueError):
        EngineConfig(weight_price=0.9)


def test_numbering_splits_hot_groups(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").otherwise("cold").alias("g"),
                                    (F.col("id") * 7919 % 2003).alias("v"))
    hot = find_hot(rows, ["g"], SkewPolicy(hot_rows=600))
    assert [r["g"] for r in hot.rows] == ["hot"]
    plain = number_rows(rows, no_hot("g"), [F.col("v")], "n")
    split = number_rows(rows, hot, [F.col("v")], "n").select(*plain.columns)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_phrase_scores_equal_pairwise_measure():
    names = [alias for _, alias in phrases()]
    texts = ["", ".", "1.5", "id", "preco unitario r$", "prazo de entrega dias", "x" * 80, "un", "unit pric", "cod cotacao final",
             "dias pagamento a vista ou boleto bancario em ate trinta dias corridos do recebimento"]
    got = phrase_scores(texts, names, lambda h, a: similarity._phrase_ratio(h, a, 0.0))
    for i, h in enumerate(texts):
        for j, a in enumerate(names):
            assert got[i, j] == pytest.approx(similarity._phrase_ratio(h, a, 0.0), abs=1e-9), (h, a)


def test_phrases_keep_their_order():
    own = [alias for concept, alias in phrases() if concept == "SUPPLIER_ID"]
    assert own == ["id fornecedor", "id do fornecedor", "codigo fornecedor", "cod fornecedor", "supplier id", "vendor id",
                   "supplier code", "vendor code"]
    assert len(phrases()) == len({alias for _, alias in phrases()})
    assert ("UNIT", "unidade base") in phrases({"UNIT": [" Únidade-Base "]})


def test_more_hot_groups_than_the_list_holds(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("g"), F.col("id").alias("n"))
    small = spark.range(20).select(F.col("id").alias("g"), (F.col("id") * 10).alias("v"))
    hot = find_hot(rows, ["g"], SkewPolicy(hot_rows=5, hot_limit=3))
    assert hot.table is not None
    got = spread_join(rows, small, hot, ["n"], "inner")
    assert sorted((r.g, r.n, r.v) for r in got.collect()) == sorted((n % 20, n, n % 20 * 10) for n in range(400))


def test_wide_foldings_are_found_fast():
    """The class of letters that fold to several holds just these, as few ranges around which others are passed by."""
    import re

    nested = text._MANY_CLASS
    parts = re.findall(r"\\x\{([0-9a-f]+)\}-\\x\{([0-9a-f]+)\}(?!&&)", nested)
    members = [c for low, high in parts for c in range(int(low, 16), int(high, 16) + 1)]
    assert sorted(members) == sorted(map(ord, text._MANY))
    # Before: one flat class, in which every character was tried against each of about a thousand members.
    assert nested.count("&&") >= len(parts) // 6 and max(len(p.split("-")) for p in re.findall(r"\[((?:\\x\{\w+\}-\\x\{\w+\})+)\]", nested)) <= 4


QUOTE = ("rfq_id string, source_row bigint, item_id string, description string, unit string, supplier string, quantity double, "
         "unit_price double, total_price double, payment string, delivery string, min_order string, freight string, "
         "validity string, observation string, status string, currency string")


def _quotes(spark):
    rows = []
    for n in range(60):
        name = (" Alfa", "ALFA ", "Beta", None, "  ", "beta")[n * 7 % 6]
        rows.append(("R1" if n % 3 else (None if n % 4 == 0 else "R2"), n, f"I{n % 4}", "texto", "UN", name, float(n % 5), 10.0 + n * 13 % 17,
                     None, None if n % 2 else f" {n} dias ", "3 dias" if n % 5 else " ", None, "CIF", "x", None, "A", "BRL"))
    return spark.createDataFrame(rows, QUOTE)


def _sorted(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_names_terms_and_cheapest_without_another_shuffle(spark):
    """In place as with oversized groups, and nothing is dealt out again when the quotes lie by request."""
    quotes = _quotes(spark)
    plain = QuoteChain(quotes.repartition(4, "rfq_id"), None)
    hot = QuoteChain(quotes, None, hot=HotKeys.of(quotes, SkewPolicy(hot_rows=2)))
    assert hot.hot.any_quotes and not plain.hot.any_quotes
    columns = quotes.columns + ["supplier_key"]
    terms = ["rfq_id", "supplier_key", "supplier", "payment", "delivery", "min_order", "freight", "validity", "observation",
             "payment_days", "delivery_days", "no_min_order", "freight_included", "freight_informed"]
    assert _sorted(plain.kept, *columns) == _sorted(hot.kept, *columns) and plain.kept.count() > 5
    assert _sorted(plain.suppliers, *terms) == _sorted(hot.suppliers, *terms)
    for df in (plain.kept, plain.suppliers):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for chain in (plain, hot):
        once = chain.written(quotes.columns)
        assert _sorted(once.quotes, *quotes.columns) == _sorted(quotes, *quotes.columns)
        for name in ("valid", "cheapest", "kept"):
            assert _sorted(getattr(once, name), *columns) == _sorted(getattr(hot, name), *columns)


def test_a_number_is_read_once_where_it_is_filtered(spark):
    df = spark.createDataFrame([("R$ 1.234,56",), ("1,234.50",), ("1.2.3",), ("x",), (None,), ("-0",), ("12",)], "v string")
    read = df.select("v", numbers.parse_locale_number(F.col("v")).alias("n")).where("n IS NOT NULL")
    assert {r.v: r.n for r in read.collect()} == {"R$ 1.234,56": 1234.56, "1,234.50": 1234.5, "1.2.3": 12.3, "-0": 0.0, "12": 12.0}
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 4


def test_unpivot_deals_out_numbers_only(spark):
    cells = spark.createDataFrame([("f", "s", r, c, v) for r, row in ((2, ("10", "20", "x", "7")), (3, ("5", "n/d", None, None)))
                                   for c, v in enumerate(row, 5)], "file string, sheet string, row_idx bigint, col_idx int, value string")
    rows = spark.createDataFrame([("f", "s", r, "i", "d", 1.0, "UN", None) for r in (2, 3)], "file string, sheet string, "
                                 "row_idx bigint, item_id string, description string, quantity double, unit string, reason string")
    proposals = spark.createDataFrame([("f", "s", 5, "A"), ("f", "s", 7, "B")], "file string, sheet string, col_idx int, supplier string")
    out = matrix.matrix_unpivot(cells, rows, proposals)
    assert _sorted(out, "row_idx", "supplier", "unit_price", "total_price") == [(2, "A", 10.0, 20.0), (3, "A", 5.0, None)]
    # Before: the texts of cells met the price columns, and became numbers above that join.
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "regexp_replace(" in line)
    assert sum("Join" in line for line in plan[:first]) == 2
