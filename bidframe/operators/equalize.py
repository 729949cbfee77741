"""Comparison of every quote with the requested item."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidframe.config import EngineConfig
from bidframe.functions import similarity as sim
from bidframe.functions.numbers import is_close
from bidframe.functions.text import add_normalized, extract_attributes, strip, tokens
from bidframe.operators.blocks import absent_cells, all_cells, item_blocks
from bidframe.operators.skew import HotGroups, copy_rows, salted, spread_join, spread_rows

NOT_QUOTED = "NÃO COTADO"
STRUCTURAL = "DIVERGÊNCIA ESTRUTURAL"
ATTRIBUTE = "DIVERGÊNCIA"
EQUIVALENT = "EQUIVALENTE"
REVISED = "EQUIVALENTE COM REVISÃO"
REVIEW = "REVISAR"
DIFFERENT = "DIVERGENTE"
DIVERGENT = (ATTRIBUTE, STRUCTURAL)

ATTRIBUTES = ("colour", "tip", "size", "grammage")


def quantity_check(requested: Column, quoted: Column) -> Column:
    return (F.when(is_close(requested, quoted, 1e-9, 1e-9), "OK").otherwise("DIVERGENTE"))


def unit_check(requested_norm: Column, quoted_norm: Column) -> Column:
    return F.when(requested_norm == quoted_norm, "OK").otherwise("DIVERGENTE")


def attribute_label(asked: Column, offered: Column) -> Column:
    """Outcome for one attribute; what only the supplier states is no divergence."""
    return (F.when(asked.isNull() & offered.isNull(), "NÃO INFORMADO")
            .when(asked.isNull(), "INFORMADO PELO FORNECEDOR")
            .when(offered.isNull(), "NÃO INFORMADO PELO FORNECEDOR")
            .when(asked == offered, "OK").otherwise("DIVERGENTE"))


def compare_attributes(asked: Column, offered: Column) -> dict[str, Column]:
    """Counts, score and labels from two attribute structs."""
    labels = {a: attribute_label(asked[a], offered[a]) for a in ATTRIBUTES}
    evaluated = sum((asked[a].isNotNull().cast("int") for a in ATTRIBUTES), F.lit(0))
    compatible = sum((F.coalesce(asked[a] == offered[a], F.lit(False)).cast("int")
                      for a in ATTRIBUTES), F.lit(0))
    return {
        "attr_evaluated": evaluated,
        "attr_compatible": compatible,
        "attr_divergences": evaluated - compatible,
        "attr_pct": F.when(evaluated == 0, 100.0).otherwise(
            compatible / F.nullif(evaluated, F.lit(0)) * 100),
        **{f"attr_{a}": label for a, label in labels.items()},
    }


def eq_status(is_zero: Column, structure_ok: Column, divergences: Column,
              is_full: Column, similarity: Column, cfg: EngineConfig) -> Column:
    return (F.when(is_zero, NOT_QUOTED)
            .when(~structure_ok, STRUCTURAL)
            .when(divergences > 0, ATTRIBUTE)
            .when(is_full, EQUIVALENT)
            .when(similarity >= cfg.similarity_high, REVISED)
            .when(similarity >= cfg.similarity_alert, REVIEW)
            .otherwise(DIFFERENT))


def _prepared(df: DataFrame, prefix: str) -> DataFrame:
    """Everything derived from a text, worked out once per item or quote, before joining."""
    norm, unit = f"{prefix}norm", f"{prefix}unit_norm"
    df = add_normalized(add_normalized(df, "description", norm), "unit", unit)
    return (df.withColumn("item_id", strip(F.col("item_id")))
            .withColumn(f"{prefix}tokens", tokens(F.col(norm)))
            .withColumn(f"{prefix}attrs", extract_attributes(F.col(norm)))
            .drop(norm))


def quoted_cells(items: DataFrame, quotes: DataFrame, cfg: EngineConfig = EngineConfig(),
                 hot: HotGroups | None = None, exact_similarity: bool = True) -> DataFrame:
    """The quoted cells of the items x suppliers grid with all checks and the status.

    ``hot`` lists oversized (request, item) groups. The frame comes back spread (salt
    kept) so that item windows need no further shuffle. Without ``exact_similarity`` the
    character-level score, which only the bands below 100 and the reported percentage
    need, is left null and nothing runs in Python.
    """
    hot = hot or HotGroups(("rfq_id", "item_id"))
    asked = _prepared(items, "r_").select(
        "rfq_id", "item_id", F.col("description").alias("req_description"),
        F.col("quantity").alias("req_quantity"), F.col("unit").alias("req_unit"),
        "r_tokens", "r_attrs", "r_unit_norm")
    left = spread_rows(_prepared(quotes, "q_"), hot, ["supplier"])
    cells = left.join(copy_rows(asked, hot), salted(hot))

    a, b = F.col("r_tokens"), F.col("q_tokens")
    cells = (cells.withColumn("is_full", sim.subset_match(a, b))
             .withColumn("is_zero", sim.nothing_shared(a, b))
             .withColumn("qty_check", quantity_check(F.col("req_quantity"), F.col("quantity")))
             .withColumn("unit_check", unit_check(F.col("r_unit_norm"), F.col("q_unit_norm"))))
    attrs = compare_attributes(F.col("r_attrs"), F.col("q_attrs"))
    cells = cells.withColumns({k: attrs[k] for k in ("attr_pct", "attr_divergences")})
    if exact_similarity:
        partial = ~F.col("is_full") & ~F.col("is_zero")
        cells = cells.withColumns({f"_{k}": F.when(partial, v)
                                   for k, v in sim.set_parts(a, b).items()})
        score = sim.token_set_score(F.col("_common"), F.col("_only_a"), F.col("_only_b"),
                                    sim.lcs(F.col("_only_a"), F.col("_only_b")))
        score = F.when(F.col("is_full"), 100.0).when(F.col("is_zero"), 0.0).otherwise(score)
    else:
        score = F.when(F.col("is_full"), 100.0).when(F.col("is_zero"), 0.0)
    structure_ok = (F.col("qty_check") == "OK") & (F.col("unit_check") == "OK")
    return (cells.withColumn("similarity", score)
            .withColumn("eq_status", eq_status(
                F.col("is_zero"), structure_ok, F.col("attr_divergences"), F.col("is_full"),
                F.col("similarity"), cfg))
            .drop("r_tokens", "q_tokens", "r_attrs", "q_attrs", "r_unit_norm", "q_unit_norm",
                  "_common", "_only_a", "_only_b", "is_full", "is_zero"))


def quote_grid(items: DataFrame, quotes: DataFrame, suppliers: DataFrame, facts: list[str],
               hot_rfq: HotGroups | None = None) -> DataFrame:
    """Every requested item of a request paired with every supplier of that request.

    A cell has the ``facts`` of its quote or nulls, and ``has_offer``. A supplier without a name has cells, but no quote.
    """
    cells = all_cells(item_blocks(items, quotes, suppliers, facts, hot_rfq), facts)
    nameless = items.join(suppliers.where("supplier IS NULL").select("rfq_id", "supplier").distinct(), "rfq_id")
    return cells.unionByName(nameless.withColumn("has_offer", F.lit(False)), allowMissingColumns=True)


GRID_COLUMNS = ("rfq_id", "item_id", "supplier", "req_description", "description", "req_quantity",
                "quantity", "req_unit", "unit", "unit_price", "similarity", "attr_pct",
                "attr_divergences", "qty_check", "unit_check", "eq_status")


def equalize(items: DataFrame, cells: DataFrame, suppliers: DataFrame,
             hot_rfq: HotGroups | None = None) -> DataFrame:
    """The full 15-column grid; cells without a quote are marked as not quoted."""
    asked = items.select("rfq_id", strip(F.col("item_id")).alias("item_id"),
                         F.col("description").alias("req_description"),
                         F.col("quantity").alias("req_quantity"), F.col("unit").alias("req_unit"))
    facts = ["description", "quantity", "unit", "unit_price", "similarity", "attr_pct", "attr_divergences",
             "qty_check", "unit_check", "eq_status"]
    absent = ~F.col("has_offer")
    return (all_cells(item_blocks(asked, cells, suppliers, facts, hot_rfq), facts)
            .withColumns({c: F.when(absent, 0.0).otherwise(F.col(c))
                          for c in ("similarity", "attr_pct")})
            .withColumn("attr_divergences", F.when(absent, 0).otherwise(F.col("attr_divergences")))
            .withColumns({c: F.when(absent, NOT_QUOTED).otherwise(F.col(c))
                          for c in ("qty_check", "unit_check", "eq_status")})
            .select(*GRID_COLUMNS))


def not_quoted(items: DataFrame, quotes: DataFrame, suppliers: DataFrame,
               hot_rfq: HotGroups | None = None) -> DataFrame:
    """Grid cells without any quote."""
    asked = items.select("rfq_id", strip(F.col("item_id")).alias("item_id"))
    quoted = quotes.select("rfq_id", strip(F.col("item_id")).alias("item_id"), "supplier")
    return absent_cells(item_blocks(asked, quoted, suppliers, [], hot_rfq)).select("rfq_id", "item_id", "supplier")


def join_terms(cells: DataFrame, indicators: DataFrame, hot: HotGroups | None = None,
               key: str = "supplier") -> DataFrame:
    """Bring the commercial indicators of each supplier to its quotes."""
    return spread_join(cells, indicators, hot or HotGroups(("rfq_id", key)), ["item_id"])
