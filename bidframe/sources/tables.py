"""Table inputs: scans, nested quotations and submissions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ("rfq_id", "item_id", "supplier", "description", "quantity", "unit", "unit_price",
                "total_price", "payment", "delivery", "freight", "min_order", "validity",
                "observation")
TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TEXT_COLUMNS])


def scan_quotes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Untyped quotes from CSV or Parquet files, every cell as text."""
    if fmt == "csv":
        return spark.read.schema(TEXT_SCHEMA).csv(path, header=True)
    data = spark.read.format(fmt).load(path)
    return data.select(*[F.col(c).cast("string").alias(c) if c in data.columns
                         else F.lit(None).cast("string").alias(c) for c in TEXT_COLUMNS])


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def flatten_quotations(nested: DataFrame) -> dict[str, DataFrame]:
    """Items, quotes and terms from rows of nested quotations.

    Expects ``rfq_id``, ``items`` (array of item structs) and ``suppliers`` (array of
    structs with ``name``, ``terms`` and ``lines``).
    """
    supplier = nested.select("rfq_id", F.explode("suppliers").alias("s"))
    return {
        "items": nested.select("rfq_id", F.inline("items")),
        "quotes": supplier.select("rfq_id", F.col("s.name").alias("supplier"), F.inline("s.lines")),
        "terms": supplier.select("rfq_id", F.col("s.name").alias("supplier"), "s.terms.*"),
    }


def submission_digest(content: str, sheet: str):
    """Hash that identifies one content together with one sheet choice."""
    return F.sha2(F.concat(F.col(content), F.lit("\x00"), F.coalesce(F.col(sheet), F.lit(""))), 256)


def dedup_submissions(df: DataFrame, content: str, sheet: str, order: str) -> DataFrame:
    """First submission of every distinct content and sheet choice.

    Only the digest is shuffled as a key, and copies collapse before the shuffle.
    """
    first = Window.partitionBy("digest").orderBy(order)
    return (df.withColumn("digest", submission_digest(content, sheet))
            .withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
