"""Supplier identity, item keys, deduplication and the tables built from quotes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidframe.functions.text import clean_text, stable_key
from bidframe.operators.skew import HotGroups, spread_join

TERM_COLUMNS = ("payment", "delivery", "min_order", "freight", "validity", "observation")
SUPPLIER_KEY = ("rfq_id", "supplier_key")


def no_hot(*keys: str) -> HotGroups:
    return HotGroups(tuple(keys))


def with_supplier_key(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("supplier_key", stable_key(F.col("supplier")))


def supplier_names(keyed: DataFrame) -> DataFrame:
    """First-seen spelling of every supplier of a request."""
    return keyed.groupBy(*SUPPLIER_KEY).agg(
        F.min_by(clean_text(F.col("supplier")), "source_row").alias("supplier"))


def canonical_suppliers(quotes: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Replace every spelling of a supplier by the first one seen in its request."""
    keyed = with_supplier_key(quotes)
    return spread_join(keyed.drop("supplier"), supplier_names(keyed),
                       hot or no_hot(*SUPPLIER_KEY), ["source_row"])


def dedup_cheapest(quotes: DataFrame, keys=("rfq_id", "item_id", "supplier")) -> DataFrame:
    """Keep the cheapest quote per item and supplier, the earliest row on ties.

    The rank filter is applied before the shuffle too, so copies of one quote collapse
    inside the scan tasks.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("unit_price").asc_nulls_last(), "source_row")
    return quotes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dropped_duplicates(quotes: DataFrame, kept: DataFrame) -> DataFrame:
    """The quotes that deduplication left out; joined by row, a key without skew."""
    return quotes.join(kept.select("rfq_id", "source_row"), ["rfq_id", "source_row"], "left_anti")


def distinct_items(quotes: DataFrame) -> DataFrame:
    """Description, quantity and unit of the first row of every item."""
    first = F.min_by(F.struct("description", "quantity", "unit"), "source_row")
    return (quotes.groupBy("rfq_id", "item_id").agg(first.alias("i"))
            .select("rfq_id", "item_id", "i.description", "i.quantity", "i.unit"))


def first_text(column: str) -> Column:
    text = clean_text(F.col(column))
    return F.min_by(text, F.when(text.isNotNull(), F.col("source_row"))).alias(column)


def terms_per_supplier(quotes: DataFrame, key: str = "supplier") -> DataFrame:
    """First non-empty text of every commercial column."""
    return quotes.groupBy("rfq_id", key).agg(*[first_text(c) for c in TERM_COLUMNS])


def quote_id_reliability(quotes: DataFrame) -> DataFrame:
    """Whether the quote code of a request is too unique per row to identify items."""
    codes = F.col("distinct_codes")
    return (quotes.groupBy("rfq_id").agg(
        F.count("quote_code").alias("codes"),
        F.count_distinct("quote_code").alias("distinct_codes"),
        F.count_distinct("description").alias("distinct_descriptions"))
        .withColumn("unreliable", (F.col("codes") == 0) | (
            (codes / F.nullif(F.col("codes"), F.lit(0)) >= 0.75)
            & (codes > F.col("distinct_descriptions")))))


def composite_item_key(description: Column, unit: Column) -> Column:
    return F.concat(clean_text(description), F.lit(" ["), F.upper(stable_key(unit)), F.lit("]"))


def repeated_codes(quotes: DataFrame) -> DataFrame:
    return (quotes.groupBy("rfq_id", "quote_code").agg(F.count(F.lit(1)).alias("uses"))
            .where("uses > 1"))


def suffix_repeated_codes(quotes: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Tell apart the rows that share a quote code by their row number."""
    out = spread_join(quotes, repeated_codes(quotes), hot or no_hot("rfq_id", "quote_code"),
                      ["source_row"])
    return out.withColumn("item_id", F.when(
        F.col("uses") > 1, F.concat("quote_code", F.lit("-L"), F.col("source_row").cast("string"))
    ).otherwise(F.col("quote_code"))).drop("uses")


def item_ids_from_codes(quotes: DataFrame, hot_rfq: HotGroups | None = None,
                        hot_code: HotGroups | None = None) -> DataFrame:
    """Item ids where only a quote code is known: composite key or suffixed code."""
    verdict = quote_id_reliability(quotes).select("rfq_id", "unreliable")
    judged = spread_join(suffix_repeated_codes(quotes, hot_code), verdict,
                         hot_rfq or no_hot("rfq_id"), ["source_row"])
    return judged.withColumn("item_id", F.when(
        F.col("unreliable"), composite_item_key(F.col("description"), F.col("unit"))
    ).otherwise(F.col("item_id"))).drop("unreliable")
