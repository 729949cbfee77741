"""From raw quotes to scored offers: the chain every report starts from."""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from bidframe.config import EngineConfig, SkewPolicy
from bidframe.operators import equalize as eq, identity as ident, quality, scoring
from bidframe.operators.skew import HotGroups, find_hot, spread_join
from bidframe.functions.text import clean_text
from bidframe.sources.staging import staged


@dataclass(frozen=True)
class HotKeys:
    """Oversized requests, items and suppliers of a quote table."""

    rfq: HotGroups = HotGroups(("rfq_id",))
    item: HotGroups = HotGroups(("rfq_id", "item_id"))
    supplier: HotGroups = HotGroups(ident.SUPPLIER_KEY)

    @staticmethod
    def of(quotes: DataFrame, policy: SkewPolicy = SkewPolicy()) -> "HotKeys":
        """Key-only counts of the quotes; items and suppliers are counted only where their request is oversized."""
        rfq = find_hot(quotes.select("rfq_id"), ["rfq_id"], policy)
        if not rfq.rows:
            return HotKeys(rfq)
        keyed = ident.with_supplier_key(quotes.select("rfq_id", "item_id", "supplier"))
        pairs = keyed.select("rfq_id", "item_id", "supplier_key")
        return HotKeys(rfq, find_hot(pairs, ["rfq_id", "item_id"], policy),
                       find_hot(pairs, list(ident.SUPPLIER_KEY), policy))

    @property
    def any_quotes(self) -> bool:
        return bool(self.rfq.rows or self.item.rows or self.supplier.rows)


@dataclass
class QuoteChain:
    """Lazy tables of the chain; each property is one DataFrame plan.

    ``quotes`` are cleaned but unchecked rows; ``items`` is the catalogue of requested
    items. Nothing runs until a caller writes or collects.
    """

    quotes: DataFrame
    items: DataFrame
    cfg: EngineConfig = field(default_factory=EngineConfig)
    hot: HotKeys = field(default_factory=HotKeys)

    @cached_property
    def valid(self) -> DataFrame:
        return ident.with_supplier_key(quality.valid_rows(self.quotes))

    @cached_property
    def cheapest(self) -> DataFrame:
        """Deduplicated on the supplier key, before any name is joined."""
        return ident.dedup_cheapest(self.valid, ("rfq_id", "item_id", "supplier_key"))

    @cached_property
    def suppliers(self) -> DataFrame:
        """One row per supplier of a request: name, terms and their indicators.

        Without oversized groups names and terms stand in the rows at hand, which are not shuffled again. With some,
        both sides are grouped by the same key, so their join adds no shuffle.
        """
        if not self.hot.any_quotes:
            first = [F.any_value(clean_text(F.col(c))).alias(c) for c in ident.TERM_COLUMNS]
            rows = self._keyed(self._in_place(self.valid, ident.TERM_COLUMNS))
            return scoring.commercial_indicators(rows.groupBy(*ident.SUPPLIER_KEY).agg(
                F.any_value("supplier").alias("supplier"), *first))
        names = ident.supplier_names(self.valid)
        terms = ident.terms_per_supplier(self.cheapest, "supplier_key")
        return scoring.commercial_indicators(names.join(terms, list(ident.SUPPLIER_KEY)))

    @cached_property
    def kept(self) -> DataFrame:
        """Deduplicated quotes under the canonical supplier name."""
        if not self.hot.any_quotes:
            return self._keyed(self._in_place(self.valid, ()))
        names = ident.supplier_names(self.valid)
        return spread_join(self.cheapest.drop("supplier"), names, self.hot.supplier,
                           ["item_id"], "inner")

    @staticmethod
    def _keyed(rows: DataFrame) -> DataFrame:
        """Rows without a request or supplier key have no name to join."""
        return rows.where("rfq_id IS NOT NULL AND supplier_key IS NOT NULL")

    @cached_property
    def offers(self) -> DataFrame:
        """Deduplicated quotes with name and commercial indicators.

        Without oversized groups names and terms come from windows over the rows at
        hand: one scan, and quotes already spread by request are not shuffled again.
        With some, each step shrinks its input before the shuffle and joins the result.
        """
        flags = ["payment_days", "delivery_days", "freight_included", "freight_informed"]
        if not self.hot.any_quotes:
            return scoring.commercial_indicators(self._named_in_place).select(
                "rfq_id", "item_id", "description", "quantity", "unit", "unit_price",
                "supplier", *flags)
        dim = self.suppliers.select("rfq_id", "supplier_key", "supplier", *flags)
        slim = self.cheapest.select("rfq_id", "item_id", "supplier_key", "description",
                                    "quantity", "unit", "unit_price")
        return spread_join(slim, dim, self.hot.supplier, ["item_id"], "inner").drop("supplier_key")

    @cached_property
    def _named_in_place(self) -> DataFrame:
        return self._in_place(self.valid, ("payment", "delivery", "min_order", "freight", "validity"))

    @staticmethod
    def _in_place(valid: DataFrame, terms: tuple[str, ...]) -> DataFrame:
        """The cheapest quotes under their supplier's first name, with its ``terms`` in place of their own: windows
        over the rows at hand."""
        order = Window.partitionBy("rfq_id", "item_id", "supplier_key").orderBy(
            F.col("unit_price").asc_nulls_last(), "source_row")
        supplier = Window.partitionBy(*ident.SUPPLIER_KEY)
        kept = F.col("_n") == 1
        numbered = valid.withColumn("_n", F.row_number().over(order))
        named = numbered.withColumns({
            "supplier": F.min_by(clean_text(F.col("supplier")), "source_row").over(supplier),
            **{c: F.min_by(c, F.when(kept & clean_text(F.col(c)).isNotNull(), F.col("source_row")))
               .over(supplier) for c in terms}})
        return named.where(kept).drop("_n")

    def written(self, columns: list[str]) -> "QuoteChain":
        """This chain with the ``columns`` of its quotes written once, each row with its verdict and its supplier's name.

        For callers that need all quotes, the valid and the kept ones. Oversized groups keep the plain plans.
        """
        if self.hot.any_quotes:
            return replace(self, quotes=staged(self.quotes.select(*columns)))
        keyed = ident.with_supplier_key(self.quotes.select(*columns)).withColumn("_ok", ~quality.is_invalid())
        order = Window.partitionBy("rfq_id", "item_id", "supplier_key", "_ok").orderBy(
            F.col("unit_price").asc_nulls_last(), "source_row")
        supplier = Window.partitionBy(*ident.SUPPLIER_KEY, "_ok")
        rows = staged(keyed.withColumn("_n", F.row_number().over(order)).withColumn(
            "_name", F.min_by(clean_text(F.col("supplier")), "source_row").over(supplier)))
        out = replace(self, quotes=rows.drop("supplier_key", "_ok", "_n", "_name"))
        best = rows.where("_ok AND _n = 1")
        out.__dict__["valid"] = rows.where("_ok").drop("_ok", "_n", "_name")
        out.__dict__["cheapest"] = best.drop("_ok", "_n", "_name")
        out.__dict__["kept"] = self._keyed(best.withColumn("supplier", F.col("_name"))).drop("_ok", "_n", "_name")
        return out

    def cells(self, exact_similarity: bool = True) -> DataFrame:
        return eq.quoted_cells(self.items, self.offers, self.cfg, self.hot.item, exact_similarity)

    def scored(self, exact_similarity: bool = False) -> DataFrame:
        return scoring.score(self.cells(exact_similarity), self.cfg, self.hot.item)

    @cached_property
    def eligible_cells(self) -> DataFrame:
        """Quoted cells with eligibility; no Python stage, no window."""
        return scoring.with_eligibility(self.cells(exact_similarity=False))

    @cached_property
    def grid(self) -> DataFrame:
        return eq.equalize(self.items, self.cells(), self.suppliers, self.hot.rfq)

    @cached_property
    def recommendations(self) -> DataFrame:
        return scoring.recommend(self.items, self.scored(), self.cfg, self.hot.item)
