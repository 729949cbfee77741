"""Comparison map, supplier summary, indicators, alerts and insights.

All of it works on the quoted cells; cells without a quote are counted from the sizes of
a request and only written out where they are the output (alerts).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bidframe.functions.text import strip

from bidframe.functions.numbers import variation_pct
from bidframe.operators.blocks import absent_cells, item_blocks
from bidframe.operators.equalize import DIVERGENT, NOT_QUOTED
from bidframe.operators.skew import HotGroups, SALT, WAYS, group_extremes, number_rows

ITEM = ["rfq_id", "item_id"]


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def number_text(c: Column) -> Column:
    """A double the way the messages print it: 12.0, 0.5."""
    return F.when(F.abs(c) >= 1e7, F.format_string("%.1f", c)).otherwise(c.cast("string"))


def spread_pct(low: Column, high: Column) -> Column:
    return F.when(low > 0, (high - low) / low * 100)


def mark_best(cells: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Add the item's lowest eligible price and whether a quote meets it."""
    price = F.when(F.col("price_eligible"), F.col("unit_price"))
    out = group_extremes(cells, hot or HotGroups(tuple(ITEM)), {"item_low": F.min(price)})
    low = F.col("item_low")
    close = F.abs(price - low) <= 1e-8 + 1e-5 * F.abs(low)
    return out.withColumn("is_best", F.coalesce(close, F.lit(False)))


def item_facts(marked: DataFrame) -> DataFrame:
    """One row per quoted item: price range, best suppliers, status counts."""
    price = F.when(F.col("price_eligible"), F.col("unit_price"))
    return marked.groupBy(*ITEM).agg(
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.array_sort(F.collect_list(F.when(F.col("is_best"), F.col("supplier"))))
        .alias("best_suppliers"),
        count_if(F.col("eq_status") != NOT_QUOTED).alias("quoted"),
        count_if(F.col("eq_status").isin(*DIVERGENT)).alias("divergent"))


def suppliers_per_rfq(suppliers: DataFrame) -> DataFrame:
    return suppliers.groupBy("rfq_id").agg(F.count_distinct("supplier").alias("n_suppliers"))


def comparative_map(items: DataFrame, marked: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Per requested item: lowest and highest eligible price, spread, best suppliers."""
    zero = F.lit(0)
    return (items.select("rfq_id", strip(F.col("item_id")).alias("item_id"), "description",
                         "quantity", "unit")
            .join(item_facts(marked), ITEM, "left")
            .join(suppliers_per_rfq(suppliers), "rfq_id", "left")
            .withColumn("spread_pct", spread_pct(F.col("min_price"), F.col("max_price")))
            .withColumn("best_suppliers", F.coalesce("best_suppliers", F.array().cast("array<string>")))
            .withColumn("divergent", F.coalesce("divergent", zero))
            .withColumn("not_quoted", F.coalesce("n_suppliers", zero) - F.coalesce("quoted", zero))
            .drop("quoted", "n_suppliers"))


def comparative_map_wide(marked: DataFrame, rfq_id: str, names: list[str]) -> DataFrame:
    """Eligible prices of one request with a column per named supplier."""
    price = F.when(F.col("price_eligible"), F.col("unit_price"))
    return (marked.where(F.col("rfq_id") == rfq_id).groupBy("item_id")
            .pivot("supplier", names).agg(F.max(price)))


def price_maps(marked: DataFrame) -> DataFrame:
    """(``rfq_id``, ``item_id``, ``prices``): eligible price by supplier, for all requests."""
    best = (marked.where("price_eligible").groupBy("rfq_id", "item_id", "supplier")
            .agg(F.max("unit_price").alias("price")))
    return best.groupBy("rfq_id", "item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("supplier", "price"))).alias("prices"))


def supplier_summary(items: DataFrame, marked: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Counts, lowest-price share of the quoted items and eligible total per supplier."""
    status = F.col("eq_status")
    facts = marked.groupBy("rfq_id", "supplier").agg(
        count_if(status != NOT_QUOTED).alias("quoted"),
        count_if(status == "EQUIVALENTE").alias("equivalent"),
        count_if(status.isin(*DIVERGENT)).alias("divergent"),
        count_if(F.col("price_eligible")).alias("eligible_prices"),
        count_if(F.col("is_best")).alias("lowest_prices"),
        F.sum(F.when(F.col("price_eligible"), F.col("unit_price") * F.col("quantity")))
        .alias("eligible_total"))
    counts = ("quoted", "equivalent", "divergent", "eligible_prices", "lowest_prices")
    n_items = items.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("n_items"))
    return (suppliers.select("rfq_id", "supplier").distinct()
            .join(facts, ["rfq_id", "supplier"], "left").join(n_items, "rfq_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
            .withColumn("eligible_total", F.coalesce("eligible_total", F.lit(0.0)))
            .withColumn("not_quoted", F.coalesce("n_items", F.lit(0)) - F.col("quoted"))
            .withColumn("lowest_pct", F.when(
                F.col("quoted") > 0, F.col("lowest_prices") / F.col("quoted") * 100).otherwise(0.0))
            .drop("n_items"))


def kpis(cmap: DataFrame, summary: DataFrame) -> DataFrame:
    """Key figures of each request from its comparison map and supplier summary."""
    per_item = cmap.groupBy("rfq_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("min_price").alias("items_with_price"),
        count_if(F.col("min_price").isNull()).alias("items_without_price"),
        count_if(F.col("divergent") > 0).alias("items_divergent"),
        count_if(F.col("not_quoted") > 0).alias("items_not_quoted"),
        F.max("spread_pct").alias("max_spread_pct"))
    lead = F.struct((-F.col("lowest_prices")).alias("n"), "supplier")
    per_supplier = summary.groupBy("rfq_id").agg(
        F.count(F.lit(1)).alias("suppliers"),
        F.min_by("supplier", lead).alias("leader"),
        F.max("lowest_prices").alias("leader_lowest_prices"))
    return per_item.join(per_supplier, "rfq_id", "left")


def executive_summary(cmap: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Size, divergences, possible saving and cost at the lowest prices per request."""
    low, high, n = F.col("min_price"), F.col("max_price"), F.col("quantity")
    facts = cmap.groupBy("rfq_id").agg(
        F.count(F.lit(1)).alias("items"),
        count_if(F.col("divergent") > 0).alias("items_divergent"),
        count_if(F.col("not_quoted") > 0).alias("items_not_quoted"),
        F.round(F.coalesce(F.sum((high - low) * n), F.lit(0.0)), 2).alias("potential_saving"),
        F.round(F.coalesce(F.sum(low * n), F.lit(0.0)), 2).alias("lowest_cost"))
    return facts.join(suppliers_per_rfq(suppliers)
                      .withColumnRenamed("n_suppliers", "suppliers"), "rfq_id", "left")


def value_ranking(summary: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Suppliers of a request by eligible total, cheapest first."""
    return number_rows(summary.select("rfq_id", "supplier", "eligible_total"),
                       hot or HotGroups(("rfq_id",)),
                       [F.col("eligible_total"), F.col("supplier")], "position")


ALERT_COLUMNS = ("rfq_id", "priority", "kind", "item_id", "description", "quantity", "unit",
                 "supplier", "message")


def _alert(df: DataFrame, priority: str, kind: str, message: Column, about_item=True,
           supplier: Column | None = None) -> DataFrame:
    item = {c: (F.col(c) if about_item else F.lit(None).cast("double" if c == "quantity" else "string"))
            for c in ("item_id", "description", "quantity", "unit")}
    return df.select("rfq_id", F.lit(priority).alias("priority"), F.lit(kind).alias("kind"),
                     *[v.alias(k) for k, v in item.items()],
                     (F.col("supplier") if supplier is None else supplier).alias("supplier"),
                     message.alias("message"))


def alerts(items: DataFrame, marked: DataFrame, suppliers: DataFrame, cmap: DataFrame,
           hot_rfq: HotGroups | None = None) -> DataFrame:
    """Divergences, missing quotes, wide spreads, minimum orders and freight notes.

    ``suppliers`` carries the commercial indicators of each supplier.
    """
    asked = items.select("rfq_id", strip(F.col("item_id")).alias("item_id"), "description",
                         "quantity", "unit")
    requested = marked.select("rfq_id", "item_id", "supplier", "eq_status",
                              F.col("req_description").alias("description"),
                              F.col("req_quantity").alias("quantity"),
                              F.col("req_unit").alias("unit"))
    quoted = marked.where(F.col("eq_status") != NOT_QUOTED)
    missing = absent_cells(item_blocks(asked, quoted, suppliers, [], hot_rfq))
    amount = F.concat_ws(" ", number_text(F.col("quantity")), "unit")
    named = F.concat(F.lit("item "), "item_id", F.lit(" ("), "description", F.lit(")"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    who, terms = F.col("supplier"), suppliers
    informed, included = F.col("freight_informed"), F.col("freight_included")
    parts = [
        _alert(requested.where(F.col("eq_status").isin(*DIVERGENT)), "ALTA", "Divergência",
               text(who, " apresenta ", F.lower("eq_status"), " no ", named, ": ", amount, ".")),
        _alert(missing, "ALTA", "Não cotado",
               text(who, " não cotou o ", named, ", quantidade ", amount, ".")),
        _alert(cmap.where(F.col("spread_pct") >= 30), "MÉDIA", "Diferença de preço",
               text("O ", named, ", quantidade ", amount, ", apresenta diferença de ",
                    F.format_string("%.2f", "spread_pct"), "% entre preços elegíveis."),
               supplier=F.lit(None).cast("string")),
        _alert(terms.where(~F.col("no_min_order")), "MÉDIA", "Pedido mínimo",
               text(who, " possui pedido mínimo informado: ", F.col("min_order"), "."), False),
        _alert(terms.where(informed & ~included), "MÉDIA", "Frete",
               text(who, " não apresenta frete incluso (", F.col("freight"), ")."), False),
        _alert(terms.where(~informed), "BAIXA", "Frete",
               text(who, " não informou a condição de frete."), False),
    ]
    return reduce(DataFrame.unionByName, parts).select(*ALERT_COLUMNS)


def insights(figures: DataFrame, cmap: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Sentences on each request; ``figures`` are its key figures.

    Each fact is a map-side combined max_by or min_by; ties go to the first item or name.
    """
    spread = cmap.where(F.col("spread_pct").isNotNull()).groupBy("rfq_id").agg(
        F.min_by("item_id", F.struct((-F.col("spread_pct")).alias("s"), "item_id")).alias("spread_item"),
        F.max("spread_pct").alias("top_spread"))
    pay, ship = F.col("payment_days"), F.col("delivery_days")
    terms = suppliers.groupBy("rfq_id").agg(
        F.min_by("supplier", F.when(pay.isNotNull(), F.struct((-pay).alias("d"), "supplier"))).alias("payer"),
        F.max(pay).alias("longest"),
        F.min_by("supplier", F.when(ship.isNotNull(), F.struct(ship.alias("d"), "supplier"))).alias("shipper"),
        F.min(ship).alias("shortest"))
    facts = figures.join(spread, "rfq_id", "left").join(terms, "rfq_id", "left")
    days = F.format_string
    said = F.array(
        F.format_string("A cotação possui %d itens e %d fornecedores participantes.", "items", "suppliers"),
        F.when(F.col("items_divergent") > 0, F.format_string(
            "Foram identificados %d item(ns) com divergências.", "items_divergent"))
        .otherwise("Não foram identificadas divergências."),
        F.when(F.col("items_not_quoted") > 0, F.format_string(
            "Existem %d item(ns) não cotados por pelo menos um fornecedor.", "items_not_quoted")),
        F.when(F.col("top_spread").isNotNull(), F.format_string(
            "A maior diferença de preço entre propostas elegíveis foi de %.2f%% no item %s.",
            "top_spread", "spread_item")),
        F.when(F.col("payer").isNotNull(), days(
            "%s apresenta o maior prazo de pagamento identificado: %.0f dias.", "payer", "longest")),
        F.when(F.col("shipper").isNotNull(), days(
            "%s apresenta o menor prazo de entrega identificado: %.0f dias.", "shipper", "shortest")))
    return (facts.select("rfq_id", F.posexplode(said).alias("position", "insight"))
            .where(F.col("insight").isNotNull()))
