"""Eligibility, scores, ranking and the recommendation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidframe.functions.text import strip

from bidframe.config import EngineConfig
from bidframe.functions import commercial as com
from bidframe.functions.numbers import is_close, is_positive
from bidframe.operators.equalize import EQUIVALENT, NOT_QUOTED
from bidframe.operators.skew import HotGroups, SALT, WAYS, group_extremes, number_rows

NO_WINNER = "NENHUM"
NO_OPTION = "SEM OPÇÃO ELEGÍVEL"
NO_OPTION_REASON = "Nenhum fornecedor atende aos critérios mínimos."
FINAL_REASON = "decisão final preservada da planilha"
ITEM = ("rfq_id", "item_id")


def commercial_indicators(terms: DataFrame) -> DataFrame:
    """Days, freight states and minimum-order flag of each supplier, texts kept."""
    return (terms.withColumn("payment_days", com.extract_days(F.col("payment")))
            .withColumn("delivery_days", com.extract_days(F.col("delivery")))
            .withColumn("no_min_order", com.no_min_order(F.col("min_order")))
            .withColumn("freight_included", com.freight_included(F.col("freight")))
            .withColumn("freight_informed", com.freight_informed(F.col("freight"))))


def price_eligible() -> Column:
    return ((F.col("eq_status") != NOT_QUOTED) & (F.col("qty_check") == "OK")
            & (F.col("unit_check") == "OK") & (F.col("attr_divergences") <= 0)
            & is_positive(F.col("unit_price")))


def with_eligibility(cells: DataFrame) -> DataFrame:
    return (cells.withColumn("price_eligible", price_eligible())
            .withColumn("eligible", F.col("price_eligible") & (F.col("eq_status") == EQUIVALENT)))


def score_class(score: Column, eligible: Column) -> Column:
    return (F.when(eligible & (score >= 90), "EXCELENTE").when(eligible & (score >= 75), "BOA")
            .when(eligible & (score >= 60), "ACEITÁVEL").otherwise("NÃO RECOMENDADO"))


def score(cells: DataFrame, cfg: EngineConfig = EngineConfig(),
          hot: HotGroups | None = None) -> DataFrame:
    """All score parts and the final score for cells that carry the supplier's terms.

    A term nobody states usefully for an item drops out of the mean instead of counting 0.
    """
    hot = hot or HotGroups(ITEM)
    df = with_eligibility(cells)
    ok, price = F.col("eligible"), F.col("unit_price")
    pay, ship = F.col("payment_days"), F.col("delivery_days")
    df = group_extremes(df, hot, {
        "_low": F.min(F.when(ok, price)),
        "_longest": F.max(F.when(ok, pay)),
        "_fastest": F.min(F.when(ok & (ship > 0), ship)),
    })
    longest, fastest = F.col("_longest"), F.col("_fastest")
    df = df.withColumns({
        "price_score": F.when(ok, F.col("_low") / price * 100).otherwise(0.0),
        "sim_score": F.when(ok, F.coalesce(F.col("similarity"), F.lit(0.0))).otherwise(0.0),
        "attr_score": F.when(ok, F.coalesce(F.col("attr_pct"), F.lit(0.0))).otherwise(0.0),
        "payment_score": F.when(ok & (longest > 0), pay / longest * 100),
        "delivery_score": F.when(ok & (ship > 0), fastest / ship * 100)
        .when(ok & fastest.isNotNull() & (ship == 0), 100.0),
        "freight_score": F.when(ok & F.coalesce("freight_informed", F.lit(False)),
                                F.coalesce("freight_included", F.lit(False)).cast("double") * 100),
    })
    parts = [F.col(c) for c in ("payment_score", "delivery_score", "freight_score")]
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    df = df.withColumn("commercial_score", F.when(
        ok, F.coalesce(total / F.nullif(known, F.lit(0)), F.lit(50.0))).otherwise(0.0))
    raw = (F.col("price_score") * cfg.weight_price + F.col("sim_score") * cfg.weight_similarity
           + F.col("attr_score") * cfg.weight_attributes
           + F.col("commercial_score") * cfg.weight_commercial)
    df = df.withColumn("final_score", F.when(
        ok, F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))).otherwise(0.0))
    return (df.withColumn("score_class", score_class(F.col("final_score"), ok))
            .drop("_low", "_longest", "_fastest"))


def rank_order() -> list[Column]:
    """Best first: score, price, similarity, attributes, terms, then supplier name."""
    return [(~F.col("eligible")).alias("_ineligible"), (-F.col("final_score")).alias("_score"),
            F.coalesce("unit_price", F.lit(float("inf"))).alias("_price"),
            (-F.col("sim_score")).alias("_sim"), (-F.col("attr_score")).alias("_attr"),
            (-F.col("commercial_score")).alias("_terms"), F.col("supplier").alias("_supplier")]


def rank_suppliers(scored: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Rank of every eligible quote within its item; others get no rank."""
    plain = scored.drop(WAYS, SALT)
    return (number_rows(plain, hot or HotGroups(ITEM), rank_order(), "rank")
            .withColumn("rank", F.when(F.col("eligible"), F.col("rank"))))


def tied_offers(scored: DataFrame, cfg: EngineConfig = EngineConfig(),
                hot: HotGroups | None = None) -> DataFrame:
    """Per item with an eligible offer: the offers within the tie margin, best first."""
    hot = hot or HotGroups(ITEM)
    best = group_extremes(scored.where("eligible"), hot, {"_best": F.max("final_score")})
    offer = F.struct(*rank_order(), "supplier", "final_score", "unit_price", "quantity",
                     "score_class", "price_score", "sim_score", "attr_score", "commercial_score")
    return (best.where(F.col("_best") - F.col("final_score") <= cfg.tie_points)
            .groupBy(*ITEM).agg(F.array_sort(F.collect_list(offer)).alias("offers")))


def reason(best: Column, tied: Column, cfg: EngineConfig) -> Column:
    """Why the winner won, as a comma-separated phrase list."""
    price, similar = best["price_score"], best["sim_score"]
    attrs, terms = best["attr_score"], best["commercial_score"]
    phrases = F.concat_ws(
        ", ",
        F.when(F.abs(price - 100) <= 1e-8 + 1e-5 * 100, "menor preço")
        .when(price >= 90, "preço muito competitivo"),
        F.when(similar >= 99.99, "descrição equivalente")
        .when(similar >= cfg.similarity_high, "descrição altamente similar"),
        F.when(attrs >= 99.99, "atributos equivalentes").when(attrs >= 80, "atributos compatíveis"),
        F.when(terms >= 90, "excelentes condições comerciais")
        .when(terms >= 70, "condições comerciais adequadas"),
        F.when(F.size(tied) > 1, F.concat(F.lit("empate técnico: "), F.array_join(tied, ", "))))
    return F.when(phrases == "", "melhor score geral").otherwise(phrases)


def recommend(items: DataFrame, scored: DataFrame, cfg: EngineConfig = EngineConfig(),
              hot: HotGroups | None = None) -> DataFrame:
    """One row per requested item with the winning supplier, ties and the reason."""
    asked = items.select("rfq_id", strip(F.col("item_id")).alias("item_id")).distinct()
    best = F.col("offers")[0]
    tied = F.coalesce(F.transform("offers", lambda o: o["supplier"]), F.array().cast("array<string>"))
    none = F.col("offers").isNull()
    return (asked.join(tied_offers(scored, cfg, hot), list(ITEM), "left")
            .select(*ITEM,
                    F.when(none, NO_WINNER).otherwise(best["supplier"]).alias("winner"),
                    F.when(none, 0.0).otherwise(best["final_score"]).alias("final_score"),
                    best["unit_price"].alias("unit_price"),
                    F.when(none, NO_OPTION).otherwise(best["score_class"]).alias("score_class"),
                    (F.size(tied) > 1).alias("technical_tie"),
                    tied.alias("tied_suppliers"),
                    F.when(none, NO_OPTION_REASON).otherwise(reason(best, tied, cfg)).alias("reason")))


def respect_final_decision(recommended: DataFrame, scored: DataFrame, reference: DataFrame,
                           finals: DataFrame) -> DataFrame:
    """Keep the buyer's final choice where its price matches the final supplier's quote.

    ``reference``: final price per item. ``finals``: the single final supplier of each
    request. Items the reference does not hold keep the computed winner.
    """
    quote = (scored.select(*ITEM, "supplier", F.col("unit_price").alias("_price"),
                           F.col("quantity").alias("_quantity"), F.col("score_class").alias("_class"))
             .join(finals.select("rfq_id", F.col("final_supplier").alias("supplier")),
                   ["rfq_id", "supplier"]))
    decided = (reference.where(F.col("final_price").isNotNull())
               .select(*ITEM, "final_price").join(quote, list(ITEM))
               .where(is_close(F.col("final_price"), F.col("_price"), 0.01, 0.01)))
    out = recommended.join(decided, list(ITEM), "left")
    hit = F.col("_price").isNotNull()
    return (out.withColumn("winner", F.when(hit, F.col("supplier")).otherwise(F.col("winner")))
            .withColumn("unit_price", F.when(hit, F.col("_price")).otherwise(F.col("unit_price")))
            .withColumn("total_value", F.when(hit, F.col("_price") * F.col("_quantity")))
            .withColumn("score_class", F.when(hit, F.col("_class")).otherwise(F.col("score_class")))
            .withColumn("reason", F.when(hit, FINAL_REASON).otherwise(F.col("reason")))
            .drop("supplier", "final_price", "_price", "_quantity", "_class"))
