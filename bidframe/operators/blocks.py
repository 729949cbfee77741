"""Items against the suppliers of their request, a block of suppliers at a time.

The full grid of a request has a cell for every item and supplier. Here the suppliers of a request
are dealt into blocks of about BLOCK names, so an item has one row for each block; which of
its suppliers quoted is a list inside that row. The names meet these rows last, so nothing of the
size of the grid is shuffled: its cells come out of their row only where they are the output.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidframe.config import SkewPolicy
from bidframe.operators.skew import HotGroups, spread_join
from bidframe.sources.staging import staged

#: Names of a block on average.
BLOCK = 2048
KEYS = ["rfq_id", "item_id", "block"]


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("supplier"), blocks).cast("int")


def supplier_blocks(suppliers: DataFrame) -> DataFrame:
    """(``rfq_id``, ``block``, ``names``): the suppliers of each request in blocks dealt by hash."""
    names = suppliers.select("rfq_id", "supplier").distinct()
    return (names.join(block_counts(suppliers), "rfq_id").groupBy("rfq_id", _block(F.col("blocks")).alias("block"))
            .agg(F.sort_array(F.collect_list("supplier")).alias("names")))


def block_counts(suppliers: DataFrame) -> DataFrame:
    """(``rfq_id``, ``blocks``): blocks of the suppliers of each request."""
    return suppliers.groupBy("rfq_id").agg(
        F.ceil(F.count_distinct("supplier") / BLOCK).cast("bigint").alias("blocks")).where("blocks > 0")


def item_blocks(items: DataFrame, offers: DataFrame, suppliers: DataFrame, facts: list[str],
                hot_rfq: HotGroups | None = None, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Every item with every block of its request's suppliers: ``names`` and ``quoted``, the offers among them.

    ``offers``: one row for an item and supplier at most; ``quoted`` holds structs of the supplier and ``facts``.
    The items of a request meet a block in parts of ``hot_rows`` cells; its offers are split by ``hot_rfq``.
    """
    # Read by several steps: the names alone, not the whole chain that leads to them.
    suppliers = staged(suppliers.select("rfq_id", "supplier").distinct())
    counts = block_counts(suppliers)
    parts = F.ceil(F.col("_items") * BLOCK / policy.hot_rows).cast("int")
    shape = items.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("_items")).join(counts, "rfq_id").select(
        "rfq_id", "blocks", parts.alias("_parts"))
    rows = (items.join(shape, "rfq_id")
            .withColumn("_part", F.pmod(F.xxhash64("item_id"), F.col("_parts")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
            .drop("blocks", "_parts"))
    placed = spread_join(offers.select("rfq_id", "item_id", "supplier", *facts), counts,
                         hot_rfq or HotGroups(("rfq_id",)), ["item_id", "supplier"], "inner")
    quoted = placed.groupBy("rfq_id", "item_id", _block(F.col("blocks")).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("supplier", *facts))).alias("quoted"))
    names = supplier_blocks(suppliers).join(shape.select("rfq_id", "_parts"), "rfq_id").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return rows.join(quoted, KEYS, "left").join(names, ["rfq_id", "block", "_part"]).drop("_part")


def _have() -> Column:
    return F.coalesce(F.transform("quoted", lambda q: q["supplier"]), F.array().cast("array<string>"))


def absent_cells(blocks: DataFrame) -> DataFrame:
    """One row for each supplier of a block that has no offer."""
    return blocks.withColumn("supplier", F.explode(F.array_except("names", _have()))).drop("block", "names", "quoted")


def present_cells(blocks: DataFrame, facts: list[str]) -> DataFrame:
    """One row for each supplier of a block that has an offer, with its ``facts``; the first, should there be more."""
    known = blocks.where("quoted IS NOT NULL").withColumn("_known", F.array_intersect(_have(), "names"))
    every = F.size("_known") == F.size("quoted")
    listed = F.when(every, F.col("quoted")).otherwise(
        F.filter("quoted", lambda q: F.array_contains("_known", q["supplier"])))
    told = known.withColumn("quoted", listed).select("*", F.posexplode("quoted").alias("_at", "_offer"))
    # Offers stand by supplier: further ones of a supplier follow its first.
    before = F.get("quoted", F.col("_at") - 1)["supplier"]
    return (told.where((F.col("_at") == 0) | ~before.eqNullSafe(F.col("_offer.supplier")))
            .withColumns({c: F.col("_offer")[c] for c in ("supplier", *facts)})
            .drop("block", "names", "quoted", "_known", "_at", "_offer"))


def all_cells(blocks: DataFrame, facts: list[str]) -> DataFrame:
    """One row for each supplier of a block, with the ``facts`` of its offer or nulls."""
    present = present_cells(blocks, facts).withColumn("has_offer", F.lit(True))
    absent = absent_cells(blocks).withColumn("has_offer", F.lit(False))
    return present.unionByName(absent, allowMissingColumns=True)
