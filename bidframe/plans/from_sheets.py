"""From sheet cells to quotes, problems and reports.

The detector runs once and its outcome, one layout for each sheet that is read, is written. The
cells then are put together into rows, typed and written once too; every report starts
from that table.
"""
from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from bidframe.config import DetectionWindow, EngineConfig, HeaderThresholds
from bidframe.operators import identity as ident, matrix as mx, quality, schema_match as sm, sheet_import as si
from bidframe.operators.schema_match import SHEET
from bidframe.operators.skew import find_hot
from bidframe.plans.detection import Detection
from bidframe.plans.quotes import HotKeys, QuoteChain
from bidframe.sources.staging import staged


class SheetImport:
    """Quotes of many files, read from the cells of their sheets.

    ``manifest``: every sheet of every file (file, sheet, readable), by default those with cells. ``wanted``:
    sheets asked for by name. ``manual``: columns given by callers (file, sheet, concept, position, header);
    a price matrix with such is read as a table. ``items``: the catalogue of the requests; without one the
    items are those of the quotes, and files in which an id stands for several are refused.
    With ``group_missing_ids``, sheets without an id column group items by description and
    unit; without, their rows are invalid.
    """

    def __init__(self, cells: DataFrame, manifest: DataFrame | None = None, wanted: DataFrame | None = None,
                 manual: DataFrame | None = None, items: DataFrame | None = None, group_missing_ids: bool = True,
                 cfg: EngineConfig = EngineConfig(), window: DetectionWindow = DetectionWindow(),
                 th: HeaderThresholds = HeaderThresholds(), labels: mx.MatrixLabels = mx.MatrixLabels()):
        self.cells, self.wanted, self.manual, self.catalogue = cells, wanted, manual, items
        self.group_missing_ids, self.cfg, self.labels = group_missing_ids, cfg, labels
        self.found = Detection(cells, window, th)
        self._manifest = manifest

    @cached_property
    def manifest(self) -> DataFrame:
        if self._manifest is not None:
            return self._manifest
        return self.found.rows.select(*SHEET, F.lit(True).alias("readable"))

    @cached_property
    def _choice(self) -> tuple[DataFrame, DataFrame]:
        chosen, unknown = si.sheet_choice(self.manifest, self.found.chosen, self.wanted)
        return staged(chosen), staged(unknown)

    @cached_property
    def _mapping(self) -> tuple[DataFrame, DataFrame]:
        """Final column of each concept of the chosen sheets, and bad wishes of callers."""
        generic = sm.generic_layout(self.found.headers)
        if self.manual is None:
            mapped, bad = sm.column_map(self.found.resolved, generic), None
        else:
            good, bad = sm.manual_mapping(self.manual, self.found.headers)
            mapped = sm.column_map(self.found.resolved, generic, good)
        chosen = self._choice[0]
        mapped = staged(mapped.join(chosen, SHEET))
        if bad is None:
            bad = mapped.select(*SHEET, "concept", F.lit("").alias("problem")).limit(0)
        return mapped, staged(bad.join(chosen, SHEET))

    @cached_property
    def _price_columns(self) -> DataFrame:
        rows = self.found.rows.join(self._choice[0], SHEET)
        if self.manual is not None:
            rows = rows.join(self.manual.select(*SHEET).distinct(), SHEET, "left_anti")
        return staged(mx.price_columns(self.found.sample, rows))

    @cached_property
    def column_problems(self) -> DataFrame:
        """What is wrong with the columns of a chosen sheet: file, sheet, concept, problem."""
        mapped, bad = self._mapping
        matrix = mx.detect_matrix(self._price_columns, self.labels).where("is_matrix")
        tables = self._choice[0].join(matrix, SHEET, "left_anti")
        ambiguous = mapped.where("problem IS NOT NULL").select(*SHEET, "concept", "problem")
        told = bad.unionByName(ambiguous)
        missing = sm.missing_columns(mapped, tables).join(told.select(*SHEET, "concept"), [*SHEET, "concept"], "left_anti")
        return staged(told.unionByName(missing).join(tables, SHEET, "left_semi"))

    @cached_property
    def layouts(self) -> DataFrame:
        """The layout of every sheet that is read."""
        refused = self.column_problems.select(*SHEET).distinct()
        chosen = self._choice[0].join(refused, SHEET, "left_anti")
        return staged(si.sheet_layouts(chosen, self.found.rows, si.sheet_sizes(self.cells), self._mapping[0],
                                       self.found.columns, self._price_columns, self.labels))

    @cached_property
    def _rows(self) -> DataFrame:
        return si.sheet_rows(self.cells, self.layouts)

    @cached_property
    def matrix_items(self) -> DataFrame:
        return si.matrix_items(self._rows)

    @cached_property
    def quotes(self) -> DataFrame:
        """Typed quotes of all files that are read, good and bad ones, each with its ``sheet_row``."""
        quotes = si.table_quotes(self._rows).unionByName(si.matrix_quotes(self.matrix_items))
        if self.group_missing_ids:
            quotes = si.group_missing_ids(quotes)
        return staged(quotes.withColumnRenamed("file", "rfq_id"))

    @cached_property
    def _repaired(self) -> DataFrame:
        valid = quality.valid_rows(self.quotes)
        hot = find_hot(valid.where("id_from_code").select("rfq_id", F.col("item_id").alias("quote_code")), ["rfq_id", "quote_code"])
        return staged(si.ids_from_codes(valid, si.code_verdicts(valid), hot))

    @cached_property
    def conflicts(self) -> DataFrame:
        """Files in which an id stands for several items; none where a catalogue says what ids mean."""
        if self.catalogue is not None:
            return self._repaired.select("rfq_id", F.lit(0).cast("bigint").alias("conflicts"), F.lit("").alias("first_id")).limit(0)
        keyed = ident.with_supplier_key(self._repaired)
        return staged(si.conflicting_files(ident.dedup_cheapest(keyed, ("rfq_id", "item_id", "supplier_key"))))

    @cached_property
    def valid(self) -> DataFrame:
        return self._repaired.join(self.conflicts.select("rfq_id"), "rfq_id", "left_anti")

    @cached_property
    def chain(self) -> QuoteChain:
        """The chain that every report starts from."""
        hot = HotKeys.of(self.valid)
        base = QuoteChain(self.valid, self.catalogue, self.cfg, hot)
        if self.catalogue is not None:
            return base
        return replace(base, items=staged(ident.distinct_items(base.cheapest)))

    # --- what became of the rows ---------------------------------------------------

    def discards(self) -> DataFrame:
        """Every line that is not used, with its reason: invalid, repeated, empty and matrix lines."""
        blank = si.blank_counts(self.layouts, self._rows).select(
            F.col("file").alias("rfq_id"), F.lit(None).cast("bigint").alias("sheet_row"),
            F.concat(F.col("blank_rows").cast("string"), F.lit(
                " linha(s) totalmente vazia(s) após o cabeçalho (ignoradas automaticamente)")).alias("reason"),
            F.lit("").alias("description"), F.lit("").alias("supplier"))
        matrix = mx.matrix_discards(self.matrix_items).withColumnRenamed("file", "rfq_id").drop("sheet")
        valid = ident.canonical_suppliers(self.valid, self.chain.hot.supplier)
        return quality.discards(self.quotes, valid, self.chain.cheapest, other=blank.unionByName(matrix))

    def notes(self) -> DataFrame:
        """Readable notes on every file that is read."""
        rows = self._repaired
        notes = quality.import_warnings(self.quotes, self.valid, self.chain.cheapest, rows.where("id_note = 'codes'"),
                                        rows.where("id_note = 'ids'"))
        grouped = rows.where("id_note = 'absent'").groupBy("rfq_id").agg(F.count(F.lit(1)).alias("rows"))
        return notes.unionByName(grouped.select("rfq_id", F.lit("grouped").alias("kind"), "rows", F.lit(
            "Nenhum identificador de item foi encontrado; os itens foram agrupados por descrição e unidade.").alias("message")))

    # --- what keeps files from being read ------------------------------------------

    def problems(self) -> DataFrame:
        """One row for each broken rule that keeps a file from being read.

        Columns: file, sheet, code, title, message, missing (labels), found (label to header), sheets (of the
        file) and hints.
        """
        columns, unknown = self.column_problems, self._choice[1]
        names = self.manifest.groupBy("file").agg(
            F.array_sort(F.collect_set("sheet")).alias("sheets"), F.max("readable").alias("any"))
        listed = F.array_join("sheets", ", ")
        label = si.concept_label
        headers = self.found.headers.join(self._choice[0], SHEET)
        parts = []

        def add(df: DataFrame, code: str, message: Column, missing: Column | None = None, hints=()):
            parts.append(df.select(
                "file", F.col("sheet") if "sheet" in df.columns else F.lit(None).cast("string").alias("sheet"),
                F.lit(code).alias("code"), F.lit(si.FILE_PROBLEMS[code]).alias("title"), message.alias("message"),
                (missing if missing is not None else F.array().cast("array<string>")).alias("missing"),
                F.array(*[h if isinstance(h, Column) else F.lit(h) for h in hints]).cast("array<string>").alias("hints")))

        def text(*bits) -> Column:
            return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

        sheet, common = F.col("sheet"), si.GENERAL_HINTS
        add(unknown.join(names.select("file", "sheets"), "file"), "aba_inexistente",
            text("A aba '", sheet, "' não existe no arquivo. Abas disponíveis: ", listed, "."),
            hints=(text("Use uma das abas disponíveis: ", listed, "."),
                   "Deixe o campo \"Aba\" em branco para usar a detecção automática."))
        add(names.where("NOT any"), "nenhuma_aba_analisavel",
            text("Nenhuma das abas pôde ser analisada. Abas do arquivo: ", listed, "."), hints=common)
        lost = columns.where("problem = 'colunas_nao_reconhecidas'").groupBy(*SHEET).agg(
            F.array_sort(F.collect_set("concept")).alias("concepts"))
        labels = F.transform("concepts", label)
        add(lost, "colunas_nao_reconhecidas", text(
            "Não foi possível reconhecer as colunas obrigatórias na aba '", sheet, "'. Faltando: ",
            F.array_join(labels, ", "), "."), labels, common)
        rivals = (self.found.columns.join(columns.where("problem = 'coluna_ambigua'").select(*SHEET, "concept"), [*SHEET, "concept"])
                  .groupBy(*SHEET, "concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                      "col_idx", "header"))), lambda x: x["header"]), ", ").alias("names")))
        name = label(F.col("concept"))
        add(rivals, "coluna_ambigua", text("Mais de uma coluna na aba '", sheet, "' parece ser ", name, ": ",
                                           F.col("names"), "."), F.array(name), (text(
            "Renomeie a coluna correta ou desambigue removendo a coluna duplicada (", F.col("names"), ")."), *common))
        if self.manual is not None:
            asked = columns.join(self.manual, [*SHEET, "concept"])
            width = headers.groupBy(*SHEET).agg(F.count(F.lit(1)).cast("string").alias("width"))
            add(asked.where("problem = 'posicao_invalida'").join(width, SHEET), "posicao_invalida", text(
                "A posição ", F.col("position").cast("string"), " informada para ", name, " não existe na aba '", sheet,
                "', que tem ", F.col("width"), " coluna(s)."), F.array(name),
                ("Use um índice de coluna entre 0 e o total de colunas menos um.",))
            add(asked.where("problem = 'coluna_manual_inexistente'"), "coluna_manual_inexistente", text(
                "A coluna '", F.col("header"), "' informada para ", name, " não foi encontrada na aba '", sheet, "'."),
                F.array(name), ("Confira o nome exato do cabeçalho, incluindo acentos.",))
        read = self.layouts.select(*SHEET)
        served = self._repaired.select(F.col("rfq_id").alias("file")).distinct()
        every = F.array(*[label(F.lit(c)) for c in sm.REQUIRED_COLUMNS])
        add(read.join(served, "file", "left_anti"), "sem_propostas_validas", text(
            "A aba '", sheet, "' não contém nenhuma proposta válida. Todos os registros encontrados estavam "
            "incompletos ou com valores inválidos."), every,
            ("Confirme que a quantidade e o preço unitário estão preenchidos e são maiores que zero.", *common))
        clash = self.conflicts.withColumnRenamed("rfq_id", "file").join(read, "file")
        add(clash, "ids_conflitantes", text(
            "O mesmo identificador de item aparece com descrição ou unidade diferentes: ", F.col("first_id"),
            F.when(F.col("conflicts") > 1, F.format_string(" e mais %d", F.col("conflicts") - 1)).otherwise(""),
            ". Cada ID deve representar um único item solicitado."), hints=(
            "Garanta que cada ID tenha sempre a mesma descrição e unidade.",
            "Se os códigos se repetem por fornecedor, use uma coluna que identifique o item de forma única."))

        first = self.found.columns.where("concept IS NOT NULL").groupBy(*SHEET, "concept").agg(
            F.min_by("header", "col_idx").alias("header"))
        found = first.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct(
            label(F.col("concept")), "header"))).alias("found"))
        out = reduce(DataFrame.unionByName, parts)
        return (out.join(found, SHEET, "left").join(names.select("file", "sheets"), "file", "left")
                .withColumn("found", F.coalesce("found", F.create_map().cast("map<string,string>"))))

    def nearest_headers(self, k: int = 3) -> DataFrame:
        """For each required concept a chosen sheet lacks, the ``k`` unmapped headers most like its phrases:
        file, sheet, concept, place, header, score, alias."""
        missing = self.column_problems.where("problem = 'colunas_nao_reconhecidas'").select(*SHEET, "concept")
        taken = self._mapping[0].where("col_idx IS NOT NULL").select(*SHEET, "col_idx")
        free = self.found.headers.join(missing.select(*SHEET).distinct(), SHEET).join(taken, [*SHEET, "col_idx"], "left_anti")
        scores = sm.concept_scores(free).select("norm", *sm.FLAGS, "concept", "alias", "score")
        return si.nearest(free, missing, scores, k)

