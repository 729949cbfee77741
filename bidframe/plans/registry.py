"""Registry of the queries and of the SQL that checks them.

The checking SQL is written from the meaning of each operator, for another engine, over
the same input views. ``CTES`` holds its shared building blocks.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from bidframe.operators import analysis
from bidframe.plans.quotes import HotKeys, QuoteChain
from bidframe.sources import bridge
from bidframe.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


@dataclass
class Inputs:
    """Lazy input tables of one data folder."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def hot(self) -> HotKeys:
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _HOT:
            _HOT[key] = HotKeys.of(bridge.quote_lines(self.spark, self.sf_dir, numbered=False))
        return _HOT[key]

    def table(self, name: str) -> DataFrame:
        return bridge.table(self.spark, self.sf_dir, name)

    @cached_property
    def plain(self) -> DataFrame:
        """Quote lines without row numbers: no shuffle."""
        return bridge.quote_lines(self.spark, self.sf_dir, numbered=False)

    @cached_property
    def lines(self) -> DataFrame:
        return bridge.quote_lines(self.spark, self.sf_dir, self.hot.rfq)

    @cached_property
    def items(self) -> DataFrame:
        return bridge.requested_items(self.spark, self.sf_dir)

    @cached_property
    def chain(self) -> QuoteChain:
        return QuoteChain(self.lines, self.items, hot=self.hot)

    @cached_property
    def marked(self) -> DataFrame:
        """The quoted cells that map, summary and figures start from, written once."""
        cells = analysis.mark_best(self.chain.eligible_cells, self.hot.item)
        return staged(cells.select("rfq_id", "item_id", "supplier", "req_description", "req_quantity", "req_unit", "quantity",
                                   "unit_price", "eq_status", "price_eligible", "is_best"))

    @cached_property
    def sellers(self) -> DataFrame:
        """The suppliers of each request. The catalogue holds every quoted item, so all of them have a cell."""
        return self.marked.select("rfq_id", "supplier").distinct()

    @cached_property
    def cmap(self) -> DataFrame:
        return analysis.comparative_map(self.items, self.marked, self.sellers)

    @cached_property
    def summary(self) -> DataFrame:
        return analysis.supplier_summary(self.items, self.marked, self.sellers)


_HOT: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query on the input tables, with its checking SQL where there is one."""

    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def expand(sql: str) -> str:
    """Put the building blocks a statement names in front of it, in order of need."""
    needed: list[str] = []

    def visit(text: str):
        for word in CTES:
            if word not in needed and re.search(rf"\b{word}\b", text):
                visit(CTES[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql
    blocks = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.lstrip()
    recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
    if body.startswith("WITH "):
        body = body.removeprefix("WITH ").removeprefix("RECURSIVE ")
        return f"WITH {recursive}{blocks},\n{body}"
    return f"WITH {blocks}\n{body}"


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
