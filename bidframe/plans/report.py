"""The whole report as named tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bidframe.operators import (analysis, blocks, equalize as eq, matrix as mx, quality, scoring, source_profile as prof,
                                views)
from bidframe.plans.registry import Inputs
from bidframe.plans.sheet_queries import Matrix
from bidframe.sources.staging import staged


def map_grid(t: Inputs) -> DataFrame:
    """Every item and supplier with the status, the eligible price and the item's best suppliers."""
    asked = (t.items.select("rfq_id", "item_id", F.col("description").alias("req_description"),
                            F.col("quantity").alias("req_quantity"), F.col("unit").alias("req_unit"))
             .join(t.cmap.select("rfq_id", "item_id", "best_suppliers"), ["rfq_id", "item_id"], "left"))
    offered = scoring.with_eligibility(t.chain.cells()).withColumn(
        "price", F.when(F.col("price_eligible"), F.col("unit_price")))
    facts = ["eq_status", "price"]
    grid = blocks.all_cells(blocks.item_blocks(asked, offered, t.chain.suppliers, facts, t.hot.rfq), facts)
    return grid.withColumn("eq_status", F.coalesce("eq_status", F.lit(eq.NOT_QUOTED)))


def with_written_base(t: Inputs) -> Inputs:
    """``t`` with what several tables start from written once: lines, items, suppliers, scored cells and their map."""
    out = Inputs(t.spark, t.sf_dir)
    out.__dict__["lines"] = staged(t.lines)
    out.__dict__["plain"] = out.lines.drop("source_row")
    out.__dict__["items"] = staged(t.items)
    chain = out.chain
    chain.__dict__["cheapest"] = staged(chain.cheapest)
    chain.__dict__["suppliers"] = staged(chain.suppliers)
    cells = staged(chain.cells())
    chain.cells = lambda exact_similarity=True: cells
    out.__dict__["cmap"] = staged(out.cmap)
    out.__dict__["summary"] = staged(out.summary)
    return out


def report_tables(t: Inputs) -> dict[str, DataFrame]:
    """Every report table as a lazy frame; write them with ``sinks.write_report_tables``."""
    chain = t.chain
    scored = chain.scored(exact_similarity=True)
    figures = analysis.kpis(t.cmap, t.summary)
    executive = analysis.executive_summary(t.cmap, t.sellers)
    counts = quality.row_counts(t.plain, chain.cheapest)
    notes = quality.import_warnings(t.lines, chain.valid, chain.cheapest)
    profile = prof.quality_profile(chain.kept, counts, notes)
    matrix = Matrix(t)
    return {
        "Dashboard": views.kpi_rows(executive),
        "Resumo": views.kpi_rows(figures),
        "Análise Executiva": views.kpi_rows(executive),
        "Ranking Executivo": analysis.value_ranking(t.summary, t.hot.rfq),
        "Insights": analysis.insights(figures, t.cmap, chain.suppliers),
        "Mapa Comparativo": views.compact_map(map_grid(t)),
        "Preços por Fornecedor": views.prices_long(t.chain.eligible_cells),
        "Fornecedores": t.summary,
        "Alertas": analysis.alerts(t.items, t.marked, chain.suppliers, t.cmap, t.hot.rfq),
        "Condições Comerciais": chain.suppliers.drop("supplier_key"),
        "Recomendações": chain.recommendations,
        "Base Recomendação": scoring.rank_suppliers(scored, t.hot.item),
        "Linhas Descartadas": quality.discards(t.lines, chain.valid, chain.cheapest),
        "Perfil da Fonte": views.kpi_rows(profile.join(prof.source_type(profile), "rfq_id")),
        "Produtos Analisados": prof.product_rollup(chain.kept),
        "Fornecedores Analisados": prof.supplier_rollup(chain.kept),
        "Referência da Matriz": matrix.reference.withColumnRenamed("file", "rfq_id"),
        "Metadados da Matriz": mx.matrix_metadata(matrix.proposals).withColumnRenamed("file", "rfq_id"),
    }
