"""Quotes, requested items and sheet cells derived from the test tables.

The column expressions are plain SQL that reads the same in Spark and in DuckDB, so the
checks start from the same input. Perturbations cover every status, unit, discard and
terms branch; nothing is filtered out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bidframe.operators.skew import HotGroups, number_rows

SIZE_TEXT = "concat(cast(p_size AS varchar(10)), 'cm')"

# Columns that depend on the part, the supplier or the line alone.
PART_COLUMNS = {
    "rfq_id": "concat(p_brand, '-', cast(p_size AS varchar(10)))",
    "item_id": "cast(p_partkey AS varchar(20))",
    "req_description": f"concat(p_name, ' ', {SIZE_TEXT})",
    "req_quantity": "cast(10 + (p_partkey % 5) * 5 AS double)",
    "req_unit": "'UN'",
    "category": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END",
}

SUPPLIER_COLUMNS = {
    "supplier_id": "s_suppkey",
    "payment": """CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'à vista'
        ELSE concat(cast(15 * (1 + s_suppkey % 6) AS varchar(10)), ' dias') END""",
    "delivery": """CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 8 = 0 THEN 'Entrega imediata'
        ELSE concat(cast(3 + s_suppkey % 20 AS varchar(10)), ' dias') END""",
    "freight": """CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Incluso' WHEN 2 THEN 'CIF' WHEN 3 THEN 'FOB'
        WHEN 4 THEN 'Não incluso' ELSE 'Frete por conta do fornecedor' END""",
    "min_order": """CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Sem mínimo' WHEN 2 THEN '0'
        WHEN 3 THEN '5 caixas' ELSE 'Não há' END""",
    "validity": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat(cast(30 + s_suppkey % 3 * 15 AS varchar(10)), ' dias') END",
    "currency": "CASE WHEN s_suppkey % 10 = 3 THEN 'USD' WHEN s_suppkey % 10 = 6 THEN NULL ELSE 'BRL' END",
}

LINE_COLUMNS = {
    "supplier": "CASE WHEN l_linenumber % 4 = 0 THEN upper(s_name) ELSE s_name END",
    "description": f"""CASE WHEN l_orderkey % 17 = 0 THEN concat('item ', p_name, ' ', {SIZE_TEXT})
        WHEN l_orderkey % 19 = 0 THEN concat(p_name, ' extra')
        WHEN l_orderkey % 23 = 0 THEN concat(p_name, ' ', cast(p_size + 1 AS varchar(10)), 'cm')
        WHEN l_orderkey % 31 = 0 THEN concat('kit ', split_part(p_name, ' ', 2), ' ', {SIZE_TEXT})
        WHEN l_orderkey % 37 = 0 THEN concat(replace(p_name, 'e', 'o'), ' ', {SIZE_TEXT})
        WHEN l_orderkey % 43 = 0 THEN 'xyz'
        ELSE concat(p_name, ' ', {SIZE_TEXT}, ' 75g') END""",
    "quantity": """CASE WHEN l_orderkey % 13 = 0 THEN l_quantity
        WHEN l_orderkey % 41 = 0 THEN NULL
        ELSE cast(10 + (p_partkey % 5) * 5 AS double) END""",
    "unit": "CASE WHEN l_orderkey % 11 = 0 THEN 'CX' WHEN l_orderkey % 2 = 0 THEN 'unid' ELSE 'UN' END",
    "price_cents": """CASE WHEN l_orderkey % 29 = 0 THEN cast(0 AS bigint)
        ELSE cast(floor(l_extendedprice * 100 / l_quantity) AS bigint) END""",
    "total_price": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END",
    "observation": "CASE WHEN l_linenumber = 7 THEN concat('lote ', l_returnflag) END",
    "status": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat(l_returnflag, l_linestatus) END",
    "quote_code": "concat('COT-', cast(l_orderkey AS varchar(20)))",
}

COLUMNS = {**PART_COLUMNS, **SUPPLIER_COLUMNS, **LINE_COLUMNS}

# Sorting that tells all source lines of a request apart.
ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

JOINS = ("lineitem JOIN part ON l_partkey = p_partkey "
         "JOIN supplier ON l_suppkey = s_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(df: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    return df.select(*keep, *[F.expr(sql).alias(name) for name, sql in columns.items()])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(table(spark, sf_dir, "part"), PART_COLUMNS, "p_partkey", "p_name", "p_size")


def quote_lines(spark: SparkSession, sf_dir: str, hot_rfqs: HotGroups | None = None,
                numbered: bool = True) -> DataFrame:
    """Every source line as a quote, with ``source_row`` numbered inside its request.

    Files of parts are far smaller than their rows, so Spark would send all parts to the driver and to every
    executor; they are shuffled instead. Suppliers go out as key and name alone.
    """
    part = _parts(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = (table(spark, sf_dir, "lineitem")
             .join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
             .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    order, hot = [F.col(c) for c in ROW_ORDER], hot_rfqs or HotGroups(("rfq_id",))
    names = [*LINE_COLUMNS, *PART_COLUMNS, *SUPPLIER_COLUMNS]
    if numbered and hot.rows:
        lines = number_rows(lines, hot, order, "source_row")
    elif numbered:
        # The narrow source columns are shuffled. Texts are built next, below the window: filters on them then stay
        # above it, where they read the texts instead of building them again.
        texts = _with(lines.repartition("rfq_id"), LINE_COLUMNS | SUPPLIER_COLUMNS, *PART_COLUMNS, *ROW_ORDER)
        return (number_rows(texts, hot, order, "source_row").select(*names, "source_row")
                .withColumn("unit_price", F.col("price_cents") / 100.0))
    return _with(lines, LINE_COLUMNS | SUPPLIER_COLUMNS, *PART_COLUMNS, *(["source_row"] if numbered else [])
                 ).select(*names, *(["source_row"] if numbered else [])
                          ).withColumn("unit_price", F.col("price_cents") / 100.0)


def quoted_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every item and supplier that a line names, with the least positive and the highest price of their lines;
    the texts of all items; the names of all suppliers in capitals.

    Lines are reduced to their keys before parts and suppliers are joined, so no text goes with them.
    """
    sold = _with(table(spark, sf_dir, "lineitem"), {"price_cents": LINE_COLUMNS["price_cents"]}, "l_partkey", "l_suppkey")
    sold = sold.groupBy("l_partkey", "l_suppkey").agg(
        F.min(F.when(F.col("price_cents") > 0, F.col("price_cents"))).alias("low"), F.max("price_cents").alias("high"))
    texts = _parts(spark, sf_dir).select("rfq_id", F.col("p_partkey").cast("bigint").alias("part"), "item_id",
                                         F.col("req_description").alias("text")).distinct()
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.upper("s_name").alias("supplier")).distinct()
    asked = texts.select("rfq_id", "part").distinct()
    pairs = (sold.join(asked.hint("shuffle_hash"), F.col("l_partkey") == F.col("part"))
             .withColumnRenamed("l_suppkey", "supplier_id").join(suppliers, "supplier_id", "left_semi"))
    return pairs.select("rfq_id", "part", "supplier_id", "low", "high"), texts, suppliers


def requested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: one row per requested item that occurs in the quotes."""
    sold = (table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
            .join(table(spark, sf_dir, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
            .select(F.col("l_partkey").alias("p_partkey")).distinct())
    return (_parts(spark, sf_dir).join(sold.hint("shuffle_hash"), "p_partkey", "left_semi")
            .select("rfq_id", "item_id", F.col("req_description").alias("description"),
                    F.col("req_quantity").alias("quantity"), F.col("req_unit").alias("unit"))
            .distinct())
