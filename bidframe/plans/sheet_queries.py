"""Queries on sheet cells: scanning, header and column matching, price matrices."""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from bidframe.functions.text import stable_key
from bidframe.operators import matrix as mx, schema_match as sm, scoring, sheet_import as si, views
from bidframe.operators.concepts import CONCEPTS, phrases
from bidframe.plans.checks import lcs_sql, token_scores_sql
from bidframe.plans.detection import Detection
from bidframe.plans.from_sheets import SheetImport
from bidframe.plans.registry import CTES, Inputs, query, rounded
from bidframe.sources import bridge, sheets
from bidframe.sources.staging import staged

# --- checking SQL: sheets ------------------------------------------------------------

_ACCENTS = ("áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def header_norm(x: str) -> str:
    text = f"translate(lower(trim({x})), '{_ACCENTS[0]}', '{_ACCENTS[1]}')"
    text = f"regexp_replace(replace({text}, '&', ' e '), '[_/\\\\|:;-]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({text}, '[^a-z0-9 .%]', ' ', 'g'), ' +', ' ', 'g'))"


CTES["sheet_cells"] = sheets.CELLS_SQL
CTES["matrix_cells"] = sheets.MATRIX_SQL
CTES["alias_list"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{k}', '{a}')" for n, (k, a) in enumerate(phrases())) + ") AS v(n, concept, alias)"
CTES["concept_list"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{c.key}', '{c.label}', {c.priority})" for n, c in enumerate(CONCEPTS)) + ") AS v(n, concept, label, priority)"

# Header rows are known from the way the sheets were laid out, the detector must find them.
CTES["header_at"] = f"""SELECT rfq_id AS file, 'Dados' AS sheet, {sheets._case(sheets.HEADER_ROW)} AS header_row,
    {sheets._case(sheets.FIRST_ROW)} AS first_row, layout FROM {sheets._FILES}
    UNION ALL SELECT rfq_id, 'Resumo', 0, 1, -1 FROM {sheets._FILES}"""

CTES["sheet_heads"] = f"""SELECT h.file, h.sheet, h.header_row, h.layout, c.col_idx, trim(c.value) AS header,
    {header_norm('c.value')} AS norm FROM header_at h JOIN sheet_cells c
    ON h.file = c.file AND h.sheet = c.sheet AND h.header_row = c.row_idx"""

_CTX = {k: " OR ".join(f"contains(norm, '{w}')" for w in words) for k, (_, words) in sm.CONTEXT.items()}
CTES["sheet_context"] = ("SELECT file, sheet, " + ", ".join(
    f"bool_or({v}) AS ctx_{k}" for k, v in _CTX.items()) + " FROM sheet_heads GROUP BY file, sheet")

_BONUS = "CASE concept " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN ctx_{k} THEN {p} ELSE 0 END" for k, (p, _) in sm.CONTEXT.items()) + " ELSE 0 END"

_FLAGS = ", ".join(f"ctx_{k}" for k in sm.CONTEXT)
_SAME_FLAGS = " AND ".join("{0}.ctx_%s = {1}.ctx_%s" % (k, k) for k in sm.CONTEXT)

# Every distinct header with every phrase: equal, contained as words, or the best of the character ratios.
CTES["phrase_pairs"] = r"""SELECT norm, n, concept, alias, norm = alias AS equal,
    regexp_matches(norm, '(^|[^a-z0-9_])' || replace(alias, '.', '\.') || '($|[^a-z0-9_])') AS inside,
    list_distinct(list_filter(string_split(norm, ' '), lambda t: t <> '')) AS ta,
    list_distinct(string_split(alias, ' ')) AS tb
    FROM (SELECT DISTINCT norm FROM sheet_heads) CROSS JOIN alias_list"""

CTES["phrase_tokens"] = token_scores_sql("phrase_pairs", "ta", "tb")

CTES["phrase_windows"] = f"""SELECT norm, n, max(200.0 * ({lcs_sql('s', 'w')}) / (length(s) + length(w))) AS part FROM (
    SELECT norm, n, s, substring(t, greatest(i, 0) + 1, least(i + length(s), length(t)) - greatest(i, 0)) AS w
    FROM (SELECT *, unnest(range(1 - length(s), length(t))) AS i FROM (
        SELECT norm, n, CASE WHEN length(norm) <= length(alias) THEN norm ELSE alias END AS s,
               CASE WHEN length(norm) <= length(alias) THEN alias ELSE norm END AS t
        FROM phrase_pairs WHERE NOT equal AND NOT inside AND length(alias) >= 4
        UNION ALL SELECT norm, n, alias, norm FROM phrase_pairs
        WHERE NOT equal AND NOT inside AND length(alias) >= 4 AND length(norm) = length(alias)) WHERE length(s) > 0))
    GROUP BY norm, n"""

CTES["phrase_scores"] = f"""SELECT p.norm, p.n, p.concept, p.alias, CASE WHEN equal THEN 100.0
    WHEN inside THEN least(97.0, 88.0 + 9.0 * length(p.alias) / length(p.norm))
    ELSE greatest(100.0 - 100.0 * (length(p.norm) + length(p.alias) - 2 * ({lcs_sql('p.norm', 'p.alias')}))
        / (length(p.norm) + length(p.alias)), similarity, 0.96 * coalesce(part, 0.0)) END AS base
    FROM phrase_tokens p LEFT JOIN phrase_windows w ON p.norm = w.norm AND p.n = w.n"""

CTES["head_scores"] = f"""SELECT *, row_number() OVER (PARTITION BY norm, {_FLAGS} ORDER BY score DESC, priority DESC, cn) AS place
    FROM (SELECT norm, {_FLAGS}, concept, round(max(s), 2) AS score, arg_min(alias, (-s, n)) AS alias
          FROM (SELECT p.norm, {_FLAGS}, concept, alias, n, least(100.0, base + {_BONUS}) AS s
                FROM (SELECT DISTINCT norm, {_FLAGS} FROM sheet_heads JOIN sheet_context USING (file, sheet)) c
                JOIN phrase_scores p ON c.norm = p.norm)
          GROUP BY norm, {_FLAGS}, concept)
    JOIN (SELECT n AS cn, concept, priority FROM concept_list) USING (concept)"""

_DERIVED = "list_has_any(string_split(norm, ' '), [" + ", ".join(f"'{w}'" for w in sm.DERIVED_WORDS) + "])"

# Concept of each distinct header and context: the exact phrase, else the best score unless low or close.
CTES["norm_class"] = f"""SELECT norm, {_FLAGS}, CASE WHEN derived OR (exact IS NULL AND unsure) THEN NULL ELSE coalesce(exact, best) END AS concept,
    CASE WHEN derived THEN 0.0 WHEN exact IS NOT NULL THEN 100.0 ELSE score END AS score,
    CASE WHEN derived THEN 'NONE' WHEN exact IS NOT NULL THEN 'HIGH' WHEN unsure THEN 'NONE' WHEN score >= 92 THEN 'HIGH'
         WHEN score >= 78 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN derived THEN NULL WHEN exact IS NOT NULL THEN first_alias ELSE alias END AS alias
    FROM (SELECT a.norm, {', '.join('a.ctx_' + k for k in sm.CONTEXT)}, a.concept AS best, a.score, a.alias, x.concept AS exact, f.first_alias,
              {_DERIVED.replace('norm', 'a.norm')} OR a.norm = '' AS derived,
              a.score < 62 OR (a.score < 78 AND a.score - coalesce(b.score, 0.0) < 3.0) AS unsure
          FROM head_scores a LEFT JOIN head_scores b ON b.place = 2 AND a.norm = b.norm AND {_SAME_FLAGS.format('a', 'b')}
          LEFT JOIN alias_list x ON a.norm = x.alias
          LEFT JOIN (SELECT concept, arg_min(alias, n) AS first_alias FROM alias_list GROUP BY concept) f ON x.concept = f.concept
          WHERE a.place = 1)"""

CTES["head_class"] = f"""SELECT h.file, h.sheet, h.header_row, h.layout, h.col_idx, h.header, h.norm, n.concept, n.score, n.confidence, n.alias
    FROM sheet_heads h JOIN sheet_context c USING (file, sheet) JOIN norm_class n ON h.norm = n.norm AND {_SAME_FLAGS.format('c', 'n')}"""


class Sheets(Detection):
    """Detected sheets of one data folder."""

    def __init__(self, t: Inputs):
        super().__init__(sheets.sheet_cells(t.lines))
        self.t = t


# --- sources -------------------------------------------------------------------------


@query("scan_cells", "SELECT file, sheet, row_idx, col_idx, value FROM sheet_cells WHERE row_idx < 100")
def scan_cells(t: Inputs) -> DataFrame:
    return sm.sample_cells(Sheets(t).cells)


@query("sheet_grid", "SELECT file, sheet, row_idx, col_idx, value FROM sheet_cells")
def sheet_grid(t: Inputs) -> DataFrame:
    """All cells of all sheets; scan_cells shows the part that the detection reads."""
    return Sheets(t).cells


@query("manual_mapping", """SELECT file, sheet, 'UNIT_PRICE' AS concept, CASE WHEN layout IN (0, 3) THEN 5 END AS col_idx,
    CASE WHEN layout NOT IN (0, 3) THEN 'coluna_manual_inexistente' END AS problem FROM header_at WHERE sheet = 'Dados'
    UNION ALL SELECT file, sheet, 'QUANTITY', CASE WHEN layout = 0 THEN NULL ELSE 2 END,
    CASE WHEN layout = 0 THEN 'posicao_invalida' END FROM header_at WHERE sheet = 'Dados'""")
def manual_mapping(t: Inputs) -> DataFrame:
    """Each file asks for its price column by name and its quantity by position."""
    s = Sheets(t)
    files = s.headers.where("sheet = 'Dados'").groupBy("file", "sheet").agg(
        F.max(F.when(F.col("col_idx") == 0, F.col("header"))).alias("head"))
    name = F.when(F.col("head") == "Campo A", "Campo F").otherwise("Preço Unitário")
    place = F.when(F.col("head") == "ID do item", 99).otherwise(2)
    asked = F.array(
        F.struct(F.lit("UNIT_PRICE").alias("concept"), F.lit(None).cast("int").alias("position"), name.alias("header")),
        F.struct(F.lit("QUANTITY").alias("concept"), place.alias("position"), F.lit(None).cast("string").alias("header")))
    wanted = files.select("file", "sheet", F.explode(asked).alias("w")).select("file", "sheet", "w.*")
    good, bad = sm.manual_mapping(wanted, s.headers)
    return (good.withColumn("problem", F.lit(None).cast("string"))
            .unionByName(bad.withColumn("col_idx", F.lit(None).cast("int"))))


# --- concepts and headers ------------------------------------------------------------


@query("concept_catalog", """SELECT c.concept, c.label, c.priority, a.aliases, coalesce(u.uses, 0) AS uses FROM concept_list c
    JOIN (SELECT concept, count(*) AS aliases FROM alias_list GROUP BY concept) a USING (concept)
    LEFT JOIN (SELECT concept, count(*) AS uses FROM sheet_heads JOIN alias_list ON norm = alias GROUP BY concept) u USING (concept)""")
def concept_catalog(t: Inputs) -> DataFrame:
    """Every concept with its phrases and how many sheet headers spell one exactly."""
    exact = sm.exact_phrases(t.spark)
    uses = (Sheets(t).headers.join(F.broadcast(exact), "norm").groupBy(F.col("exact").alias("concept"))
            .agg(F.count(F.lit(1)).alias("uses")))
    sizes = exact.groupBy(F.col("exact").alias("concept")).agg(F.count(F.lit(1)).alias("aliases"))
    base = t.spark.createDataFrame([(c.key, c.label, c.priority) for c in CONCEPTS],
                                   "concept string, label string, priority int")
    return (base.join(sizes, "concept").join(uses, "concept", "left")
            .withColumn("uses", F.coalesce("uses", F.lit(0))))


@query("normalize_header", f"SELECT DISTINCT value, {header_norm('value')} AS normalized FROM sheet_cells WHERE value IS NOT NULL")
def normalize_header(t: Inputs) -> DataFrame:
    top = Sheets(t).cells.where("value IS NOT NULL").select("value").distinct()
    return top.withColumn("normalized", sm.normalize_header(F.col("value")))


@query("reject_derived_headers", f"SELECT header, count(*) AS n FROM sheet_heads WHERE {_DERIVED} GROUP BY header")
def reject_derived_headers(t: Inputs) -> DataFrame:
    return (Sheets(t).headers.where(sm.is_derived(F.col("norm"))).groupBy("header")
            .agg(F.count(F.lit(1)).alias("n")))


@query("match_exact_alias", """SELECT header, concept, count(*) AS n FROM sheet_heads JOIN alias_list ON norm = alias
    GROUP BY header, concept""")
def match_exact_alias(t: Inputs) -> DataFrame:
    exact = F.broadcast(sm.exact_phrases(t.spark))
    return (Sheets(t).headers.join(exact, "norm").groupBy("header", F.col("exact").alias("concept"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("score_alias", "SELECT norm, concept, alias, round(base, 4) AS score FROM phrase_scores")
def score_alias(t: Inputs) -> DataFrame:
    """Every distinct header with every phrase."""
    return rounded(sm.alias_scores(Sheets(t).headers, every=True).select(
        "norm", "concept", "alias", F.col("base").alias("score")), "score")


@query("context_bonus", "SELECT file, sheet, " + ", ".join(f"ctx_{k}" for k in sm.CONTEXT) + " FROM sheet_context")
def context_bonus(t: Inputs) -> DataFrame:
    return Sheets(t).headers.select("file", "sheet", *sm.FLAGS).distinct()


@query("rank_candidates", f"SELECT norm, {_FLAGS}, concept, alias, score, priority, place FROM head_scores WHERE place <= 5")
def rank_candidates(t: Inputs) -> DataFrame:
    return sm.rank_candidates(sm.concept_scores(Sheets(t).headers)).drop("n")


@query("classify_header", "SELECT file, sheet, col_idx, header, concept, confidence FROM head_class")
def classify_header(t: Inputs) -> DataFrame:
    """Concept per column by header alone."""
    s = Sheets(t)
    return (s.headers.join(sm.classify(s.headers), ["norm", *sm.FLAGS])
            .select("file", "sheet", "col_idx", "header", "concept", "confidence"))


@query("explain_header", f"""SELECT c.*, alternatives FROM norm_class c JOIN (SELECT norm, {_FLAGS}, string_agg(
        place || ' ' || concept || ' ' || printf('%.2f', score) || ' ' || alias, '; ' ORDER BY place) AS alternatives
    FROM head_scores WHERE place <= 5 GROUP BY norm, {_FLAGS}) a ON c.norm = a.norm AND {_SAME_FLAGS.format('c', 'a')}""")
def explain_header(t: Inputs) -> DataFrame:
    """Best match of each distinct header and context, with the five best as text."""
    said = lambda x: F.format_string("%d %s %.2f %s", x["place"], x["concept"], x["score"], x["alias"])
    return sm.explain(Sheets(t).headers).withColumn("alternatives", F.array_join(F.transform("alternatives", said), "; "))


_BODY = """(SELECT c.file, c.sheet, c.col_idx, h.layout, trim(c.value) AS v FROM sheet_cells c JOIN header_at h
    ON c.file = h.file AND c.sheet = h.sheet WHERE c.row_idx > h.header_row AND c.row_idx < 100 AND c.value IS NOT NULL)"""
_NUM = r"""CASE WHEN regexp_matches(v, '^[\sR$€£+-]*\d[\d.,\s]*$') THEN try_cast(replace(
    regexp_replace(v, '[^0-9,.-]', '', 'g'), ',', '.') AS double) END"""
_UNITS = ", ".join(f"'{u}'" for u in sm.UNIT_VALUES)

CTES["col_profile"] = rf"""SELECT file, sheet, col_idx, count(*) AS filled, count(num) * 1.0 / count(*) AS numeric_share,
    coalesce(count(*) FILTER (WHERE num % 1 = 0) * 1.0 / nullif(count(num), 0), 0.0) AS integer_share,
    1 - count(num) * 1.0 / count(*) AS text_share, count(DISTINCT v) * 1.0 / count(*) AS unique_ratio,
    median(length(v)) AS median_length,
    count(*) FILTER (WHERE contains(v, '$') OR contains(v, '€') OR contains(v, '£')) * 1.0 / count(*) AS currency,
    count(DISTINCT u) AS distinct_values, count(DISTINCT CASE WHEN u IN ({_UNITS}) THEN u END) * 1.0 / count(DISTINCT u) AS unit_ratio
    FROM (SELECT *, {_NUM} AS num, regexp_replace(lower(v), '\.+$', '') AS u FROM {_BODY}) GROUP BY file, sheet, col_idx"""


@query("column_profile", """SELECT file, sheet, col_idx, filled, round(numeric_share, 4) AS numeric_share, round(integer_share, 4) AS integer_share,
    round(text_share, 4) AS text_share, round(unique_ratio, 4) AS unique_ratio, median_length, round(currency, 4) AS currency,
    distinct_values, round(unit_ratio, 4) AS unit_ratio FROM col_profile""")
def column_profile(t: Inputs) -> DataFrame:
    out = (Sheets(t).profile.withColumnRenamed("numeric", "numeric_share")
           .withColumnRenamed("integer", "integer_share"))
    return rounded(out, "numeric_share", "integer_share", "text_share", "unique_ratio", "currency", "unit_ratio")


CTES["col_evidence"] = """SELECT *, least(26.0, 24 * unit_ratio + CASE WHEN unique_ratio <= 0.2 THEN 4 ELSE 0 END) AS ev_UNIT,
    least(22.0, 12 * text_share + CASE WHEN median_length >= 8 THEN 6 ELSE 0 END + CASE WHEN unique_ratio >= 0.75 THEN 4 ELSE 0 END) AS ev_DESCRIPTION,
    least(22.0, 12 * text_share + CASE WHEN unique_ratio < 0.8 AND distinct_values >= 2 THEN 8 ELSE 0 END) AS ev_SUPPLIER,
    least(22.0, 12 * text_share + CASE WHEN unique_ratio >= 0.8 THEN 8 ELSE 0 END + CASE WHEN median_length <= 40 THEN 2 ELSE 0 END) AS ev_ID,
    least(22.0, 16 * numeric_share + 4 * integer_share) AS ev_QUANTITY,
    least(22.0, 16 * numeric_share + 5 * currency + 12 * (1 - integer_share)) AS ev_UNIT_PRICE,
    least(22.0, 16 * numeric_share) AS ev_PAYMENT_DAYS FROM col_profile"""
_EV = ("UNIT", "DESCRIPTION", "SUPPLIER", "ID", "QUANTITY", "UNIT_PRICE", "PAYMENT_DAYS")


@query("data_evidence", "SELECT file, sheet, col_idx, " + ", ".join(
    f"round(ev_{c}, 4) AS ev_{c}" for c in _EV) + " FROM col_evidence")
def data_evidence(t: Inputs) -> DataFrame:
    out = sm.evidence_scores(Sheets(t).profile).select("file", "sheet", "col_idx", *[f"ev_{c}" for c in _EV])
    return rounded(out, *[f"ev_{c}" for c in _EV])


_ORDERED = ("DESCRIPTION", "SUPPLIER", "UNIT", "ID", "QUANTITY", "UNIT_PRICE")
_TOPEV = "greatest(" + ", ".join(f"round(ev_{c}, 9)" for c in _ORDERED) + ")"


_INFERRED = f"CASE WHEN {_TOPEV} < 14 THEN NULL " + " ".join(
    f"WHEN round(ev_{c}, 9) = {_TOPEV} THEN '{c}'" for c in _ORDERED) + " END"


@query("infer_concept", f"""SELECT file, sheet, col_idx, {_INFERRED} AS inferred,
    CASE WHEN {_TOPEV} >= 14 THEN round({_TOPEV}, 4) END AS inferred_score FROM col_evidence""")
def infer_concept(t: Inputs) -> DataFrame:
    out = sm.infer_concept(sm.evidence_scores(Sheets(t).profile))
    return rounded(out.select("file", "sheet", "col_idx", "inferred", "inferred_score"), "inferred_score")


@query("find_header_row", "SELECT file, sheet, header_row, CASE WHEN layout = -1 THEN 2 ELSE 12 END AS width FROM header_at")
def find_header_row(t: Inputs) -> DataFrame:
    return Sheets(t).rows.select("file", "sheet", "header_row", "width")


@query("find_data_start", "SELECT file, sheet, first_row + 1 AS data_start FROM header_at")
def find_data_start(t: Inputs) -> DataFrame:
    s = Sheets(t)
    return sm.find_data_start(s.sample, s.rows)


@query("clean_header", """SELECT file, sheet, col_idx, header FROM sheet_heads""")
def clean_header(t: Inputs) -> DataFrame:
    return Sheets(t).headers.select("file", "sheet", "col_idx", "header")


@query("select_sheet", "SELECT DISTINCT file, 'Dados' AS sheet FROM header_at")
def select_sheet(t: Inputs) -> DataFrame:
    s = Sheets(t)
    return s.chosen.select("file", "sheet")


@query("suppliers_in_headers", "SELECT file, sheet, 'Fornecedor X' AS supplier FROM header_at WHERE layout = 4")
def suppliers_in_headers(t: Inputs) -> DataFrame:
    return sm.suppliers_in_headers(Sheets(t).headers)


@query("project_concepts", f"""SELECT b.file, b.sheet, b.row_idx, {', '.join(
    f"max(value) FILTER (WHERE m.concept = '{c}') AS {c}" for c in sm.MAPPED)}
    FROM (SELECT c.* FROM sheet_cells c JOIN header_at h ON c.file = h.file AND c.sheet = h.sheet WHERE c.row_idx > h.header_row) b
    JOIN col_map m ON b.file = m.file AND b.sheet = m.sheet AND b.col_idx = m.col_idx GROUP BY b.file, b.sheet, b.row_idx""")
def project_concepts(t: Inputs) -> DataFrame:
    s = Sheets(t)
    mapped = sm.column_map(s.resolved, sm.generic_layout(s.headers))
    return sm.project_concepts(s.cells, s.rows, mapped)


@query("detection_warnings")
def detection_warnings(t: Inputs) -> DataFrame:
    s = Sheets(t)
    return sm.detection_warnings(s.columns, s.rows, sheets.sheet_manifest(t.plain))


# Every column with its concept by header, or by content where the header is weak.
_POINTS = "CASE c.concept " + " ".join(f"WHEN '{k}' THEN ev_{e}" for k, e in [(e, e) for e in _EV] + [
    ("TOTAL_PRICE", "UNIT_PRICE"), ("DELIVERY_DAYS", "PAYMENT_DAYS")]) + " END"
CTES["col_match"] = f"""SELECT file, sheet, header_row, col_idx, header, norm, CASE WHEN guess THEN inferred ELSE concept END AS concept,
    score, confidence, alias, round(CASE WHEN guess THEN top ELSE coalesce(points, 0.0) END, 2) AS data_score, guess AS from_content
    FROM (SELECT c.*, {_POINTS} AS points, {_TOPEV} AS top, {_INFERRED} AS inferred,
              c.confidence IN ('LOW', 'NONE') AND coalesce({_TOPEV} >= 14, false) AS guess
          FROM head_class c LEFT JOIN col_evidence e ON c.file = e.file AND c.sheet = e.sheet AND c.col_idx = e.col_idx)"""

_NEEDED = ", ".join(f"'{c}'" for c in ("ID", *sm.REQUIRED_COLUMNS))
_ASKED = ", ".join(f"'{c}'" for c in (*sm.MAPPED, "QUOTE_ID"))
CTES["col_resolved"] = f"""WITH ranked_cols AS (SELECT *, score + data_score AS total, count(*) OVER w AS uses,
        row_number() OVER (w ORDER BY score + data_score DESC, data_score DESC, col_idx) AS place,
        lead(score + data_score) OVER (w ORDER BY score + data_score DESC, data_score DESC, col_idx) AS next_total
        FROM col_match WHERE concept IN ({_ASKED}) WINDOW w AS (PARTITION BY file, sheet, concept)),
    picked AS (SELECT file, sheet, concept,
        CASE WHEN uses = 1 OR (concept IN ({_NEEDED}) AND total >= next_total + 4) THEN col_idx END AS col_idx,
        CASE WHEN uses > 1 AND concept IN ({_NEEDED}) AND NOT total >= next_total + 4 THEN 'coluna_ambigua' END AS problem
        FROM ranked_cols WHERE place = 1)
    SELECT * FROM picked WHERE concept <> 'QUOTE_ID' UNION ALL SELECT p.file, p.sheet, 'ID', p.col_idx, p.problem FROM picked p
    LEFT JOIN picked i ON i.concept = 'ID' AND p.file = i.file AND p.sheet = i.sheet
    WHERE p.concept = 'QUOTE_ID' AND p.col_idx IS NOT NULL AND i.file IS NULL"""

CTES["col_map"] = """SELECT coalesce(r.file, g.file) AS file, coalesce(r.sheet, g.sheet) AS sheet, coalesce(r.concept, g.concept) AS concept,
    coalesce(g.col_idx, r.col_idx) AS col_idx, CASE WHEN g.col_idx IS NULL AND r.col_idx IS NULL THEN r.problem END AS problem
    FROM col_resolved r FULL JOIN (SELECT file, sheet, col_idx, concept FROM header_at JOIN (VALUES """ + ", ".join(
    f"({n}, '{c}')" for n, c in enumerate(sm.GENERIC_LAYOUT)) + """) AS v(col_idx, concept) ON layout = 3) g
    ON r.file = g.file AND r.sheet = g.sheet AND r.concept = g.concept"""


@query("column_matches", "SELECT * FROM col_match")
def column_matches(t: Inputs) -> DataFrame:
    return Sheets(t).columns


@query("resolve_columns", "SELECT file, sheet, concept, col_idx FROM col_resolved WHERE col_idx IS NOT NULL")
def resolve_columns(t: Inputs) -> DataFrame:
    """Mapped columns of all sheets."""
    return Sheets(t).resolved.where("col_idx IS NOT NULL").select("file", "sheet", "concept", "col_idx")


@query("column_problems", "SELECT file, sheet, concept, problem FROM col_map WHERE problem IS NOT NULL UNION ALL "
       "SELECT h.file, h.sheet, v.concept, 'colunas_nao_reconhecidas' FROM header_at h CROSS JOIN (VALUES " + ", ".join(
           f"('{c}')" for c in sm.REQUIRED_COLUMNS) + """) AS v(concept) LEFT JOIN col_map m ON h.file = m.file AND h.sheet = m.sheet
    AND v.concept = m.concept AND m.col_idx IS NOT NULL WHERE m.file IS NULL""")
def column_problems(t: Inputs) -> DataFrame:
    s = Sheets(t)
    mapped = sm.column_map(s.resolved, sm.generic_layout(s.headers))
    found = mapped.where("problem IS NOT NULL").select("file", "sheet", "concept", "problem")
    return found.unionByName(sm.missing_columns(mapped, s.rows))


@query("generic_layout", "SELECT file, sheet, concept, col_idx FROM header_at JOIN (VALUES " + ", ".join(
    f"({n}, '{c}')" for n, c in enumerate(sm.GENERIC_LAYOUT)) + ") AS g(col_idx, concept) ON layout = 3")
def generic_layout(t: Inputs) -> DataFrame:
    return sm.generic_layout(Sheets(t).headers)


# --- from cells to quotes and recommendations ----------------------------------------

_LABEL = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in si.CONCEPT_LABELS.items()) + f" ELSE {c} END"

CTES["sheet_list"] = sheets.MANIFEST_SQL
# The data sheet of every file is the one that is read, unless callers ask for one that does not exist.
CTES["col_trouble"] = """SELECT file, sheet, concept, problem FROM col_map WHERE problem IS NOT NULL AND sheet = 'Dados' AND file NOT LIKE '%7'
    UNION ALL SELECT h.file, h.sheet, v.concept, 'colunas_nao_reconhecidas' FROM header_at h CROSS JOIN (VALUES """ + ", ".join(
    f"('{c}')" for c in sm.REQUIRED_COLUMNS) + """) AS v(concept) LEFT JOIN col_map m ON h.file = m.file AND h.sheet = m.sheet
    AND v.concept = m.concept WHERE m.file IS NULL AND h.sheet = 'Dados' AND h.file NOT LIKE '%7'"""

_ASSEMBLED = ", ".join(f"max(value) FILTER (WHERE m.concept = '{c}') AS {c}" for c in si.QUOTE_COLUMNS)
_CELL_NUMBER = "try_cast(replace(regexp_replace({}, '[^0-9,.-]', '', 'g'), ',', '.') AS double)"
_TYPED = ", ".join(
    f"{_CELL_NUMBER.format(c)} AS {n}" if n in si.NUMBERS else
    f"nullif(upper(trim({c})), '') AS {n}" if n == "unit" else f"nullif(trim({c}), '') AS {n}"
    for c, n in si.QUOTE_COLUMNS.items())
CTES["cell_quotes"] = f"""SELECT file AS rfq_id, row_idx + 1 AS sheet_row, {_TYPED} FROM (
    SELECT b.file, b.row_idx, {_ASSEMBLED}
    FROM (SELECT c.* FROM sheet_cells c JOIN header_at h ON c.file = h.file AND c.sheet = h.sheet
          WHERE c.row_idx > h.header_row AND c.sheet = 'Dados' AND c.file NOT LIKE '%7'
          AND c.value IS NOT NULL AND c.file NOT IN (SELECT file FROM col_trouble)) b
    JOIN col_map m ON b.file = m.file AND b.sheet = m.sheet AND b.col_idx = m.col_idx
    WHERE m.concept IN ({', '.join(f"'{c}'" for c in si.QUOTE_COLUMNS)}) GROUP BY b.file, b.row_idx)"""


class Imported(SheetImport):
    """The files of one data folder, read from their cells, with the catalogue of what was asked for."""

    def __init__(self, t: Inputs):
        manifest = sheets.sheet_manifest(t.plain)
        super().__init__(sheets.sheet_cells(t.lines), manifest, sheets.wanted_sheets(manifest), items=t.items)


@query("quotes_from_cells", "SELECT rfq_id, sheet_row, item_id, description, quantity, unit, supplier, round(unit_price, 4) AS unit_price, "
       "total_price, payment, delivery, min_order, freight, observation FROM cell_quotes")
def quotes_from_cells(t: Inputs) -> DataFrame:
    """Typed quotes of every file that can be read."""
    return rounded(Imported(t).quotes.select(
        "rfq_id", "sheet_row", "item_id", "description", "quantity", "unit", "supplier", "unit_price", "total_price",
        "payment", "delivery", "min_order", "freight", "observation"), "unit_price")


# The whole chain of checks again, with the quotes read from cells in place of the lines.
CTES["cell_lines"] = """SELECT *, sheet_row AS source_row, cast(round(unit_price * 100) AS bigint) AS price_cents FROM cell_quotes"""
_CHAIN = ("good", "first_names", "named", "kept", "terms", "indicators", "quote_texts", "pairs", "statuses", "cells", "offers",
          "part_scores", "commercial", "finals", "ranked", "winners")
for _name in _CHAIN:
    CTES[f"cell_{_name}"] = re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"cell_\1", CTES[_name]).replace("FROM lines", "FROM cell_lines")


@query("recommend_from_cells", """SELECT rfq_id, item_id, winner, round(final_score, 4) AS final_score,
    round(unit_price, 4) AS unit_price, score_class FROM cell_winners""")
def recommend_from_cells(t: Inputs) -> DataFrame:
    """The recommendation, with nothing but sheet cells and the catalogue to start from.

    Files that name items only by quote codes, or have ambiguous columns, recommend nothing.
    """
    return rounded(Imported(t).chain.recommendations.select(
        "rfq_id", "item_id", "winner", "final_score", "unit_price", "score_class"), "final_score", "unit_price")


_RIVALS = """(SELECT m.file, m.sheet, m.concept, string_agg(m.header, ', ' ORDER BY m.col_idx) AS names FROM col_match m JOIN col_trouble p
    ON p.problem = 'coluna_ambigua' AND m.file = p.file AND m.sheet = p.sheet AND m.concept = p.concept GROUP BY m.file, m.sheet, m.concept)"""
_NAMES = "(SELECT file, string_agg(sheet, ', ' ORDER BY sheet) AS names FROM sheet_list GROUP BY file)"


@query("import_problems", f"""SELECT file, sheet, code, title, message, missing FROM (
    SELECT file, 'Planilha1' AS sheet, 'aba_inexistente' AS code, 'Aba não encontrada' AS title,
        concat('A aba ''Planilha1'' não existe no arquivo. Abas disponíveis: ', names, '.') AS message, '' AS missing
    FROM {_NAMES} WHERE file LIKE '%7'
    UNION ALL SELECT file, NULL, 'nenhuma_aba_analisavel', 'Nenhuma aba analisável',
        concat('Nenhuma das abas pôde ser analisada. Abas do arquivo: ', names, '.'), ''
    FROM {_NAMES} WHERE file LIKE '%-quebrado'
    UNION ALL SELECT file, sheet, 'colunas_nao_reconhecidas', 'Colunas obrigatórias não reconhecidas',
        concat('Não foi possível reconhecer as colunas obrigatórias na aba ''', sheet, '''. Faltando: ',
               string_agg({_LABEL('concept')}, ', ' ORDER BY concept), '.'), string_agg({_LABEL('concept')}, '; ' ORDER BY concept)
    FROM col_trouble WHERE problem = 'colunas_nao_reconhecidas' GROUP BY file, sheet
    UNION ALL SELECT file, sheet, 'coluna_ambigua', 'Coluna ambígua', concat('Mais de uma coluna na aba ''', sheet, ''' parece ser ',
        {_LABEL('concept')}, ': ', names, '.'), {_LABEL('concept')} FROM {_RIVALS}
    UNION ALL SELECT DISTINCT h.file, h.sheet, 'sem_propostas_validas', 'Nenhuma proposta válida', concat('A aba ''', h.sheet,
        ''' não contém nenhuma proposta válida. Todos os registros encontrados estavam incompletos ou com valores inválidos.'),
        '{'; '.join(si.CONCEPT_LABELS[c] for c in sm.REQUIRED_COLUMNS)}'
    FROM header_at h WHERE h.sheet = 'Dados' AND h.file NOT LIKE '%7' AND h.file NOT IN (SELECT file FROM col_trouble)
        AND h.file NOT IN (SELECT rfq_id FROM cell_quotes WHERE quantity > 0 AND unit_price > 0 AND item_id IS NOT NULL
            AND description IS NOT NULL AND unit IS NOT NULL AND supplier IS NOT NULL))""")
def import_problems(t: Inputs) -> DataFrame:
    """What keeps files from being read, one row for each broken rule."""
    return Imported(t).problems().select("file", "sheet", "code", "title", "message", F.array_join("missing", "; ").alias("missing"))


@query("import_notes")
def import_notes(t: Inputs) -> DataFrame:
    """Readable notes on every file that is read from its cells."""
    return Imported(t).notes()


# --- price matrix --------------------------------------------------------------------

_PRICE_COLS = """(SELECT file, sheet, col_idx, label FROM (SELECT c.file, c.sheet, c.col_idx, c.label, h.value AS head, n.value AS nxt
    FROM (SELECT file, sheet, col_idx, value AS label FROM matrix_cells WHERE row_idx = 0 AND col_idx >= 5) c
    LEFT JOIN matrix_cells h ON h.file = c.file AND h.row_idx = 1 AND h.col_idx = c.col_idx
    LEFT JOIN matrix_cells n ON n.file = c.file AND n.row_idx = 1 AND n.col_idx = c.col_idx + 1)
    WHERE head = 'Unitário' OR (head IS NULL AND nxt = 'Total'))"""
_PROPOSALS = f"""(SELECT file, sheet, col_idx, label, n > 1 AS is_final, CASE WHEN n > 1 THEN label || ' (Final)' ELSE label END AS supplier
    FROM (SELECT *, row_number() OVER (PARTITION BY file, label ORDER BY col_idx) AS n FROM {_PRICE_COLS}
    WHERE label NOT IN ('BASELINE', 'TARGET')))"""
_ITEM_ROWS = """(SELECT *, CASE WHEN item_id IS NULL THEN 'linha sem identificador de item'
    WHEN lower(item_id) = 'total' THEN 'linha de total (ignorada de propósito)'
    WHEN description IS NULL AND quantity IS NULL THEN 'descrição do item ausente; quantidade ausente'
    WHEN description IS NULL THEN 'descrição do item ausente' WHEN quantity IS NULL THEN 'quantidade ausente' END AS reason
    FROM (SELECT file, sheet, row_idx, max(value) FILTER (WHERE col_idx = 0) AS item_id, max(value) FILTER (WHERE col_idx = 1) AS description,
        coalesce(max(value) FILTER (WHERE col_idx = 3), max(value) FILTER (WHERE col_idx = 2), 'UN') AS unit,
        try_cast(max(value) FILTER (WHERE col_idx = 4) AS double) AS quantity
        FROM matrix_cells WHERE row_idx > 1 GROUP BY file, sheet, row_idx))"""
_FINALS = f"(SELECT file, max(supplier) AS final_supplier, max(col_idx) AS col_idx FROM {_PROPOSALS} WHERE is_final GROUP BY file HAVING count(*) = 1)"


class Matrix:
    """Matrix tables of one data folder; the header is the second row. The cells are written once."""

    def __init__(self, t: Inputs):
        pairs, texts, suppliers = bridge.quoted_pairs(t.spark, t.sf_dir)
        self.cells = staged(sheets.matrix_cells(staged(pairs), texts, suppliers))
        # Row 0 names the suppliers, row 1 is the header, as the sheets were laid out.
        self.rows = staged(self.cells.groupBy("file", "sheet").agg(
            (F.max("col_idx") + 1).alias("width")).withColumn("header_row", F.lit(1).cast("bigint")))

    @cached_property
    def columns(self) -> DataFrame:
        return staged(mx.price_columns(self.cells, self.rows))

    @cached_property
    def proposals(self) -> DataFrame:
        return staged(mx.tag_final_round(self.columns))

    @cached_property
    def items(self) -> DataFrame:
        return mx.item_rows(self.cells, self.rows)

    @property
    def reference(self) -> DataFrame:
        return mx.matrix_reference(self.cells, self.items, self.columns, self.proposals, keep=staged)


@query("detect_matrix", f"""SELECT file, sheet, count(*) AS price_columns, count(*) FILTER (WHERE label NOT IN ('BASELINE', 'TARGET')) AS proposals,
    count(*) >= 3 AND count(*) FILTER (WHERE label NOT IN ('BASELINE', 'TARGET')) >= 2 AS is_matrix FROM {_PRICE_COLS} GROUP BY file, sheet""")
def detect_matrix(t: Inputs) -> DataFrame:
    return mx.detect_matrix(Matrix(t).columns)


@query("tag_final_round", f"SELECT file, sheet, col_idx, label, is_final, supplier FROM {_PROPOSALS}")
def tag_final_round(t: Inputs) -> DataFrame:
    return Matrix(t).proposals.select("file", "sheet", "col_idx", "label", "is_final", "supplier")


@query("matrix_unpivot", f"""SELECT r.file, r.sheet, r.row_idx, r.item_id, r.description, r.quantity, r.unit, p.supplier,
    try_cast(c.value AS double) AS unit_price, try_cast(n.value AS double) AS total_price
    FROM {_ITEM_ROWS} r JOIN {_PROPOSALS} p ON r.file = p.file
    JOIN matrix_cells c ON c.file = r.file AND c.row_idx = r.row_idx AND c.col_idx = p.col_idx AND c.value IS NOT NULL
    LEFT JOIN matrix_cells n ON n.file = r.file AND n.row_idx = r.row_idx AND n.col_idx = p.col_idx + 1
    WHERE r.reason IS NULL""")
def matrix_unpivot(t: Inputs) -> DataFrame:
    m = Matrix(t)
    return mx.matrix_unpivot(m.cells, m.items, m.proposals)


_REFERENCE = f"""SELECT r.file, r.sheet, r.row_idx, r.item_id, r.description, r.quantity, try_cast(b.value AS double) AS baseline,
    cast(NULL AS double) AS adjusted_baseline, cast(NULL AS double) AS minimum_study, try_cast(g.value AS double) AS target,
    try_cast(f.value AS double) AS final_price
    FROM {_ITEM_ROWS} r
    LEFT JOIN (SELECT file, min(col_idx) AS col_idx FROM {_PRICE_COLS} WHERE label = 'BASELINE' GROUP BY file) bc ON bc.file = r.file
    LEFT JOIN (SELECT file, min(col_idx) AS col_idx FROM {_PRICE_COLS} WHERE label = 'TARGET' GROUP BY file) gc ON gc.file = r.file
    LEFT JOIN {_FINALS} fc ON fc.file = r.file
    LEFT JOIN matrix_cells b ON b.file = r.file AND b.row_idx = r.row_idx AND b.col_idx = bc.col_idx
    LEFT JOIN matrix_cells g ON g.file = r.file AND g.row_idx = r.row_idx AND g.col_idx = gc.col_idx
    LEFT JOIN matrix_cells f ON f.file = r.file AND f.row_idx = r.row_idx AND f.col_idx = fc.col_idx
    WHERE r.item_id IS NOT NULL AND lower(r.item_id) <> 'total' AND r.description IS NOT NULL"""


@query("matrix_reference", _REFERENCE)
def matrix_reference(t: Inputs) -> DataFrame:
    return Matrix(t).reference


@query("matrix_discards", f"""SELECT file, sheet, row_idx + 1 AS sheet_row, reason, coalesce(description, '') AS description,
    '' AS supplier FROM {_ITEM_ROWS} WHERE reason IS NOT NULL""")
def matrix_discards(t: Inputs) -> DataFrame:
    return mx.matrix_discards(Matrix(t).items)


@query("matrix_metadata", f"""SELECT p.file, p.sheet, string_agg(p.supplier, ', ' ORDER BY p.col_idx) AS suppliers,
    max(f.final_supplier) AS final_supplier, 'Matriz de equalização com propostas iniciais e finais' AS matrix_type
    FROM {_PROPOSALS} p LEFT JOIN {_FINALS} f ON p.file = f.file GROUP BY p.file, p.sheet""")
def matrix_metadata(t: Inputs) -> DataFrame:
    return mx.matrix_metadata(Matrix(t).proposals).withColumn("suppliers", F.array_join("suppliers", ", "))


def _finals(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Final price per item, and the final supplier under its name in the quotes."""
    m = Matrix(t)
    reference = m.reference.select(F.col("file").alias("rfq_id"), "item_id", "final_price")
    plain = stable_key(F.regexp_replace("final_supplier", r" \(Final\)$", ""))
    finals = (mx.final_suppliers(m.proposals)
              .select(F.col("file").alias("rfq_id"), plain.alias("supplier_key"))
              .join(t.chain.suppliers.select("rfq_id", "supplier_key", "supplier"), ["rfq_id", "supplier_key"])
              .select("rfq_id", F.col("supplier").alias("final_supplier")))
    return reference, finals


_NAMED_FINALS = f"""(SELECT n.rfq_id, n.name AS final_supplier FROM {_FINALS} f JOIN first_names n
    ON n.rfq_id = f.file AND n.supplier_key = lower(replace(f.final_supplier, ' (Final)', '')))"""

_DECIDED = f"""SELECT r.file AS rfq_id, r.item_id, c.supplier, c.unit_price, c.quantity, c.score_class FROM ({_REFERENCE}) r
    JOIN {_NAMED_FINALS} f ON f.rfq_id = r.file
    JOIN ranked c ON c.rfq_id = r.file AND c.item_id = r.item_id AND c.supplier = f.final_supplier
    WHERE r.final_price IS NOT NULL AND abs(r.final_price / 100.0 - c.unit_price)
        <= greatest(0.01 * greatest(abs(r.final_price / 100.0), abs(c.unit_price)), 0.01)"""


@query("join_reference", f"""SELECT w.rfq_id, w.item_id, w.winner, r.final_price, f.final_supplier FROM winners w
    LEFT JOIN ({_REFERENCE}) r ON w.rfq_id = r.file AND w.item_id = r.item_id
    LEFT JOIN {_NAMED_FINALS} f ON w.rfq_id = f.rfq_id""")
def join_reference(t: Inputs) -> DataFrame:
    reference, finals = _finals(t)
    return (t.chain.recommendations.select("rfq_id", "item_id", "winner")
            .join(reference, ["rfq_id", "item_id"], "left").join(finals, "rfq_id", "left"))


@query("respect_final_decision", f"""SELECT w.rfq_id, w.item_id, coalesce(d.supplier, w.winner) AS winner,
    round(coalesce(d.unit_price, w.unit_price), 4) AS unit_price, round(d.unit_price * d.quantity, 4) AS total_value,
    coalesce(d.score_class, w.score_class) AS score_class,
    d.rfq_id IS NOT NULL AS decided FROM winners w LEFT JOIN ({_DECIDED}) d ON w.rfq_id = d.rfq_id AND w.item_id = d.item_id""")
def respect_final_decision(t: Inputs) -> DataFrame:
    reference, finals = _finals(t)
    reference = reference.withColumn("final_price", F.col("final_price") / 100.0)
    # Read twice: by the recommendation and by the decision.
    scored = staged(t.chain.scored().drop("req_description", "req_quantity", "req_unit", "description", "unit"))
    recommended = scoring.recommend(t.items, scored, t.chain.cfg, t.hot.item)
    out = scoring.respect_final_decision(recommended, scored, reference, finals)
    return rounded(out.select("rfq_id", "item_id", "winner", "unit_price", "total_value", "score_class",
                              (F.col("reason") == scoring.FINAL_REASON).alias("decided")),
                   "unit_price", "total_value")


@query("scenario_totals", f"""SELECT rfq_id, scenario, sum(price * w) AS total FROM (
    SELECT file AS rfq_id, 'baseline' AS scenario, baseline AS price, coalesce(nullif(quantity, 0), 1) AS w FROM ({_REFERENCE})
    UNION ALL SELECT file, 'target', target, coalesce(nullif(quantity, 0), 1) FROM ({_REFERENCE})
    UNION ALL SELECT file, 'final_price', final_price, coalesce(nullif(quantity, 0), 1) FROM ({_REFERENCE}))
    GROUP BY rfq_id, scenario HAVING sum(price * w) > 0""")
def scenario_totals(t: Inputs) -> DataFrame:
    return views.scenario_totals(Matrix(t).reference.withColumnRenamed("file", "rfq_id"))
