"""Queries on quotes: cleaning, similarity, quality, identity, joins, scores, reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bidframe.functions import commercial as com, numbers as num, similarity as sim, text
from bidframe.operators import (analysis, equalize as eq, identity as ident, quality, scoring,
                                source_profile as prof, views)
from bidframe.plans.checks import (attrs_sql, days_sql, included_sql, informed_sql, key_sql, lcs_sql,
                                   no_min_sql, norm_sql, tokens_sql)
from bidframe.plans.registry import Inputs, query, rounded
from bidframe.sources import sinks, tables
from bidframe.sources.staging import staged, written

# --- sources -------------------------------------------------------------------------


@query("scan_quotes", """SELECT rfq_id, item_id, supplier, description, cast(cast(quantity AS bigint) AS varchar) AS quantity, unit,
    cast(price_cents AS varchar) AS unit_price, cast(cast(floor(total_price) AS bigint) AS varchar) AS total_price, payment,
    delivery, freight, min_order, validity, observation FROM lines""")
def scan_quotes(t: Inputs) -> DataFrame:
    """The lines written as CSV files and read back by the reader, every cell as text."""
    whole = {"quantity": F.col("quantity").cast("bigint"), "unit_price": F.col("price_cents"),
             "total_price": F.floor("total_price")}
    cells = [whole.get(c, F.col(c)).cast("string").alias(c) for c in tables.TEXT_COLUMNS]
    return tables.scan_quotes(t.spark, written(t.plain.select(*cells), "csv"))


@query("load_tables", """SELECT 'items' AS part, rfq_id, NULL AS supplier, item_id, description AS said, 1 AS n FROM items
    UNION ALL SELECT 'quotes', rfq_id, supplier, item_id, description, count(*) FROM lines GROUP BY rfq_id, supplier, item_id, description
    UNION ALL SELECT DISTINCT 'terms', rfq_id, supplier, NULL, payment, 1 FROM lines""")
def load_tables(t: Inputs) -> DataFrame:
    """Items, quotes and terms out of nested quotations; each holds a part of a request's items or of a supplier's lines."""
    part = F.pmod(F.xxhash64("item_id"), F.lit(16)).alias("part")
    line = F.struct("item_id", "description", "quantity", "unit", "unit_price", "total_price", "observation")
    terms = ("payment", "delivery", "freight", "min_order", "validity")
    offers = (t.plain.groupBy("rfq_id", "supplier", *terms, part).agg(F.collect_list(line).alias("lines"))
              .select("rfq_id", F.array(F.struct(F.col("supplier").alias("name"), F.struct(*terms).alias("terms"), "lines"))
                      .alias("suppliers")))
    asked = t.items.groupBy("rfq_id", part).agg(
        F.collect_list(F.struct("item_id", "description", "quantity", "unit")).alias("items")).drop("part")
    flat = tables.flatten_quotations(offers.unionByName(asked, allowMissingColumns=True))
    none, one = F.lit(None).cast("string"), F.lit(1).cast("bigint").alias("n")
    quotes = flat["quotes"].groupBy("rfq_id", "supplier", "item_id", F.col("description").alias("said")).agg(
        F.count(F.lit(1)).alias("n"))
    return (flat["items"].select(F.lit("items").alias("part"), "rfq_id", none.alias("supplier"), "item_id",
                                 F.col("description").alias("said"), one)
            .unionByName(quotes.select(F.lit("quotes").alias("part"), "rfq_id", "supplier", "item_id", "said", "n"))
            .unionByName(flat["terms"].select(F.lit("terms").alias("part"), "rfq_id", "supplier", none.alias("item_id"),
                                              F.col("payment").alias("said"), one).distinct()))


@query("to_json_records")
def to_json_records(t: Inputs) -> DataFrame:
    return sinks.to_json_records(
        t.chain.recommendations.withColumn("final_score", F.round("final_score", 4)),
        ["rfq_id", "item_id"])


@query("dedup_submissions", """SELECT digest, min(doc_id) AS doc_id FROM (
    SELECT doc_id, sha256(text || chr(0) || coalesce(source, '')) AS digest FROM documents) GROUP BY digest""")
def dedup_submissions(t: Inputs) -> DataFrame:
    docs = t.table("documents").select("doc_id", "text", "source")
    return tables.dedup_submissions(docs, "text", "source", "doc_id").select("digest", "doc_id")


# --- cleaning ------------------------------------------------------------------------


@query("clean_text", """SELECT doc_id, nullif(trim(text, e' \\t\\n\\r'), '') AS cleaned,
    nullif(trim(replace(source, 'a', ' ')), '') AS cleaned_source FROM documents""")
def clean_text(t: Inputs) -> DataFrame:
    return t.table("documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("cleaned"),
        text.clean_text(F.replace("source", F.lit("a"), F.lit(" "))).alias("cleaned_source"))


@query("parse_locale_number", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(l_extendedprice, 2) AS parsed, cast(NULL AS double) AS word FROM lineitem""")
def parse_locale_number(t: Inputs) -> DataFrame:
    """Prices written in three locale styles read back as numbers."""
    fmt = "format_number(l_extendedprice, 2)"
    styled = F.expr(f"""CASE l_linenumber % 3 WHEN 0 THEN {fmt}
        WHEN 1 THEN concat('R$ ', translate({fmt}, ',.', '.,')) ELSE replace({fmt}, ',', '') END""")
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(num.parse_locale_number(styled), 2).alias("parsed"),
        num.parse_locale_number(F.col("l_returnflag")).alias("word"))


@query("positive_number", """SELECT rfq_id, count(*) FILTER (WHERE quantity > 0) AS good_quantity,
    count(*) FILTER (WHERE unit_price > 0) AS good_price, count(*) AS n FROM lines GROUP BY rfq_id""")
def positive_number(t: Inputs) -> DataFrame:
    return t.plain.groupBy("rfq_id").agg(
        analysis.count_if(num.is_positive(F.col("quantity"))).alias("good_quantity"),
        analysis.count_if(num.is_positive(F.col("unit_price"))).alias("good_price"),
        F.count(F.lit(1)).alias("n"))


@query("stable_key", f"""SELECT supplier_key, count(*) AS n, count(DISTINCT supplier) AS spellings
    FROM (SELECT supplier, {key_sql("'  ' || supplier || '  SA '")} AS supplier_key FROM lines)
    GROUP BY supplier_key""")
def stable_key(t: Inputs) -> DataFrame:
    padded = F.concat(F.lit("  "), "supplier", F.lit("  SA "))
    return (t.plain.select("supplier", text.stable_key(padded).alias("supplier_key"))
            .groupBy("supplier_key").agg(F.count(F.lit(1)).alias("n"),
                                         F.count_distinct("supplier").alias("spellings")))


@query("normalize_text", f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def normalize_text(t: Inputs) -> DataFrame:
    return text.add_normalized(t.table("documents").select("doc_id", "text"), "text", "normalized"
                               ).select("doc_id", "normalized")


@query("extract_attributes", f"""SELECT doc_id, {attrs_sql('norm', '')} FROM (
    SELECT doc_id, {norm_sql('text')} AS norm FROM documents)
    UNION ALL SELECT p_partkey, {attrs_sql('norm', '')} FROM (SELECT p_partkey,
        {norm_sql("concat(p_name, ' azul ponta fina ', p_size, ',5 cm 90 g')")} AS norm FROM part)""")
def extract_attributes(t: Inputs) -> DataFrame:
    docs = t.table("documents").select("doc_id", "text")
    parts = t.table("part").select(F.col("p_partkey").alias("doc_id"), F.concat(
        "p_name", F.lit(" azul ponta fina "), F.col("p_size").cast("string"),
        F.lit(",5 cm 90 g")).alias("text"))
    return (text.add_normalized(docs.unionByName(parts), "text", "n")
            .withColumn("a", text.extract_attributes(F.col("n")))
            .select("doc_id", "a.colour", "a.tip", "a.size", "a.grammage"))


_TERMS = "(SELECT DISTINCT supplier_id, payment, delivery, freight, min_order FROM lines)"


def _term_texts(t: Inputs) -> DataFrame:
    return t.plain.select("supplier_id", "payment", "delivery", "freight", "min_order").distinct()


@query("extract_days", f"""SELECT supplier_id, {days_sql('payment')} AS payment_days,
    {days_sql('delivery')} AS delivery_days FROM {_TERMS}""")
def extract_days(t: Inputs) -> DataFrame:
    return _term_texts(t).select(
        "supplier_id", com.extract_days(F.col("payment")).alias("payment_days"),
        com.extract_days(F.col("delivery")).alias("delivery_days"))


@query("freight_state", f"""SELECT supplier_id, freight, {informed_sql('freight')} AS informed,
    {included_sql('freight')} AS included FROM {_TERMS}""")
def freight_state(t: Inputs) -> DataFrame:
    return _term_texts(t).select(
        "supplier_id", "freight", com.freight_informed(F.col("freight")).alias("informed"),
        com.freight_included(F.col("freight")).alias("included"))


@query("no_min_order", f"""SELECT supplier_id, min_order, {no_min_sql('min_order')} AS no_minimum
    FROM {_TERMS}""")
def no_min_order(t: Inputs) -> DataFrame:
    return _term_texts(t).select("supplier_id", "min_order",
                                 com.no_min_order(F.col("min_order")).alias("no_minimum"))


@query("clean_unit", """SELECT unit_text, count(*) AS n FROM (SELECT CASE WHEN trim(padded) = '' THEN NULL
    ELSE upper(trim(padded)) END AS unit_text FROM (SELECT concat(' ', unit, ' ') AS padded FROM lines))
    GROUP BY unit_text""")
def clean_unit(t: Inputs) -> DataFrame:
    padded = F.concat(F.lit(" "), "unit", F.lit(" "))
    return (t.plain.select(text.clean_unit(padded).alias("unit_text"))
            .groupBy("unit_text").agg(F.count(F.lit(1)).alias("n")))


@query("variation_pct", """SELECT rfq_id, item_id, CASE WHEN lo > 0 THEN round((hi - lo) / lo * 100, 2) END AS variation
    FROM (SELECT rfq_id, item_id, min(unit_price) AS lo, max(unit_price) AS hi FROM lines GROUP BY rfq_id, item_id)""")
def variation_pct(t: Inputs) -> DataFrame:
    return (t.plain.groupBy("rfq_id", "item_id")
            .agg(F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"))
            .select("rfq_id", "item_id", num.variation_pct(F.col("lo"), F.col("hi")).alias("variation")))


# --- similarity ----------------------------------------------------------------------

def _text_pairs(t: Inputs) -> DataFrame:
    pairs = t.plain.select("req_description", "description").distinct()
    pairs = text.add_normalized(text.add_normalized(pairs, "req_description", "a"), "description", "b")
    return pairs.withColumn("ta", text.tokens(F.col("a"))).withColumn("tb", text.tokens(F.col("b")))


@query("indel_ratio", f"""SELECT req_description, description, round(CASE WHEN length(a) + length(b) = 0 THEN 100.0
    ELSE 100.0 - 100.0 * (length(a) + length(b) - 2 * ({lcs_sql('a', 'b')})) / (length(a) + length(b)) END, 4) AS ratio
    FROM line_pairs""")
def indel_ratio(t: Inputs) -> DataFrame:
    return _text_pairs(t).select("req_description", "description",
                                 F.round(sim.indel_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


# Windows of the shorter text's length in the longer, cut off at both ends; of equally long texts both ways.
_WINDOWS = """SELECT req_description, description, s, substring(t, greatest(i, 0) + 1, least(i + length(s), length(t)) - greatest(i, 0)) AS w
    FROM (SELECT *, unnest(range(1 - length(s), length(t))) AS i FROM (
        SELECT req_description, description, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s,
               CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM line_pairs
        UNION ALL SELECT req_description, description, b, a FROM line_pairs WHERE length(a) = length(b)) WHERE length(s) > 0)"""


@query("partial_ratio", f"""SELECT p.req_description, p.description, round(CASE WHEN length(a) + length(b) = 0 THEN 100.0
    ELSE coalesce(best, 0.0) END, 4) AS ratio FROM line_pairs p LEFT JOIN (
    SELECT req_description, description, max(200.0 * ({lcs_sql('s', 'w')}) / (length(s) + length(w))) AS best
    FROM ({_WINDOWS}) GROUP BY req_description, description) USING (req_description, description)""")
def partial_ratio(t: Inputs) -> DataFrame:
    return _text_pairs(t).select("req_description", "description",
                                 F.round(sim.partial_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


def _with_similarity(pairs: DataFrame) -> DataFrame:
    parts = sim.set_parts(F.col("ta"), F.col("tb"))
    named = pairs.withColumns({f"_{k}": v for k, v in parts.items()})
    return named.withColumn("similarity", sim.token_set_score(
        F.col("_common"), F.col("_only_a"), F.col("_only_b"),
        sim.lcs(F.col("_only_a"), F.col("_only_b"))))


@query("token_set_similarity", "SELECT req_description, description, round(similarity, 4) AS similarity FROM line_scores")
def token_set_similarity(t: Inputs) -> DataFrame:
    return (_with_similarity(_text_pairs(t))
            .select("req_description", "description", F.round("similarity", 4).alias("similarity")))


@query("token_subset_match", f"""SELECT req_description, description,
    list_has_any(x, y) AND (list_has_all(x, y) OR list_has_all(y, x)) AS is_full
    FROM (SELECT req_description, description, {tokens_sql('na')} AS x, {tokens_sql('nb')} AS y FROM (
        SELECT req_description, description, {norm_sql('req_description')} AS na,
        {norm_sql('description')} AS nb FROM (SELECT DISTINCT req_description, description FROM lines)))""")
def token_subset_match(t: Inputs) -> DataFrame:
    return _text_pairs(t).select("req_description", "description",
                                 sim.subset_match(F.col("ta"), F.col("tb")).alias("is_full"))


@query("similarity_band", """SELECT req_description, description, round(similarity, 4) AS similarity, CASE WHEN similarity >= 85
    THEN 'ALTA' WHEN similarity >= 65 THEN 'REVISAR' ELSE 'BAIXA' END AS band FROM line_scores""")
def similarity_band(t: Inputs) -> DataFrame:
    """Band of each distinct pair of requested and quoted text."""
    pairs = _with_similarity(_text_pairs(t))
    return pairs.select("req_description", "description", F.round("similarity", 4).alias("similarity"),
                        sim.similarity_band(F.col("similarity"), 85.0, 65.0).alias("band"))


# --- row quality ---------------------------------------------------------------------

_OPTIONAL = ("total_price", "payment", "delivery", "freight", "min_order", "validity", "observation")
_BLANK = " AND ".join(f"{c} IS NULL" for c in _OPTIONAL)


@query("drop_blank_rows", f"""SELECT rfq_id, count(*) AS rows, count(*) FILTER (WHERE {_BLANK}) AS blank_rows,
    count(*) FILTER (WHERE NOT ({_BLANK})) AS filled_rows FROM lines GROUP BY rfq_id""")
def drop_blank_rows(t: Inputs) -> DataFrame:
    blank = quality.all_blank(_OPTIONAL)
    return t.plain.groupBy("rfq_id").agg(
        F.count(F.lit(1)).alias("rows"), analysis.count_if(blank).alias("blank_rows"),
        analysis.count_if(~blank).alias("filled_rows"))


@query("invalid_rows", "SELECT rfq_id, source_row, item_id, quantity, unit_price FROM bad")
def invalid_rows(t: Inputs) -> DataFrame:
    return quality.invalid_rows(t.lines).select("rfq_id", "source_row", "item_id", "quantity", "unit_price")


_REASON = """concat_ws('; ', CASE WHEN quantity IS NULL THEN 'quantidade ausente'
    WHEN quantity <= 0 THEN 'quantidade inválida (' || cast(quantity AS varchar) || ')' END,
    CASE WHEN unit_price <= 0 THEN 'preço unitário inválido (' || cast(unit_price AS varchar) || ')' END)"""


@query("discard_reasons", f"""SELECT rfq_id, source_row AS sheet_row, {_REASON} AS reason,
    description, supplier FROM bad""")
def discard_reasons(t: Inputs) -> DataFrame:
    return quality.discard_reasons(t.lines)


_DUP = """SELECT n.rfq_id, n.source_row, n.description, n.supplier FROM named n
    LEFT JOIN kept k ON n.rfq_id = k.rfq_id AND n.source_row = k.source_row WHERE k.rfq_id IS NULL"""


def _named(t: Inputs) -> DataFrame:
    return ident.canonical_suppliers(t.chain.valid, t.hot.supplier)


@query("discards", f"""SELECT rfq_id, source_row AS sheet_row, {_REASON} AS reason, description, supplier FROM bad
    UNION ALL SELECT rfq_id, source_row,
    'proposta duplicada para o mesmo item e fornecedor; mantida a menor cotação', description, supplier FROM ({_DUP})""")
def discards(t: Inputs) -> DataFrame:
    return quality.discards(t.lines, _named(t), t.chain.cheapest)


@query("total_mismatch", """SELECT rfq_id, source_row, total_price, round(quantity * unit_price, 4) AS expected_total
    FROM lines WHERE abs(total_price - quantity * unit_price) > greatest(abs(quantity * unit_price) * 0.01, 0.01)""")
def total_mismatch(t: Inputs) -> DataFrame:
    return rounded(quality.total_mismatch(t.lines).select(
        "rfq_id", "source_row", "total_price", "expected_total"), "expected_total")


@query("row_counts", """SELECT p.rfq_id, p.physical_rows, coalesce(u.used_rows, 0) AS used_rows,
    p.physical_rows - coalesce(u.used_rows, 0) AS discarded_rows
    FROM (SELECT rfq_id, count(*) AS physical_rows FROM lines GROUP BY rfq_id) p
    LEFT JOIN (SELECT rfq_id, count(*) AS used_rows FROM kept GROUP BY rfq_id) u ON p.rfq_id = u.rfq_id""")
def row_counts(t: Inputs) -> DataFrame:
    return quality.row_counts(t.plain, t.chain.cheapest)


@query("strict_mode", """SELECT rfq_id, min(CASE WHEN quantity > 0 AND unit_price > 0 THEN 1 ELSE 0 END) = 1 AS accepted
    FROM lines GROUP BY rfq_id""")
def strict_mode(t: Inputs) -> DataFrame:
    """Which requests strict mode would accept: those without any invalid row."""
    return t.plain.groupBy("rfq_id").agg(F.bool_and(~quality.is_invalid()).alias("accepted"))


@query("item_conflicts", """SELECT rfq_id, item_id, count(DISTINCT coalesce(description, chr(1))) > 1 AS description_differs,
    count(DISTINCT coalesce(unit, chr(1))) > 1 AS unit_differs FROM good GROUP BY rfq_id, item_id
    HAVING count(DISTINCT coalesce(description, chr(1))) > 1 OR count(DISTINCT coalesce(unit, chr(1))) > 1""")
def item_conflicts(t: Inputs) -> DataFrame:
    return quality.item_conflicts(quality.valid_rows(t.plain))


# Ids and names as a careless sheet might hold them.
_SLOPPY = {
    "item_id": """CASE WHEN l_orderkey % 47 = 0 THEN concat(cast(p_partkey AS varchar(20)), 'A')
        WHEN l_orderkey % 53 = 0 THEN concat(' ', cast(p_partkey AS varchar(20)), ' ')
        WHEN l_orderkey % 59 = 0 THEN ' ' ELSE cast(p_partkey AS varchar(20)) END""",
    "supplier": "CASE WHEN l_suppkey % 61 = 60 THEN NULL ELSE s_name END",
    "rfq_id": "concat(p_brand, '-', cast(p_size AS varchar(10)))",
}
_SLOPPY_SQL = ("SELECT " + ", ".join(f"{v} AS {k}" for k, v in _SLOPPY.items())
               + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")


def _sloppy(t: Inputs) -> DataFrame:
    return (t.table("lineitem").join(t.table("part"), F.expr("l_partkey = p_partkey"))
            .join(t.table("supplier"), F.expr("l_suppkey = s_suppkey"))
            .select(*[F.expr(v).alias(k) for k, v in _SLOPPY.items()]))


@query("unknown_items", f"""WITH s AS ({_SLOPPY_SQL}) SELECT s.rfq_id, s.supplier, trim(s.item_id) AS item_id,
    count(*) AS rows FROM s LEFT JOIN items i ON s.rfq_id = i.rfq_id AND trim(s.item_id) = i.item_id
    WHERE i.item_id IS NULL GROUP BY s.rfq_id, s.supplier, trim(s.item_id)""")
def unknown_items(t: Inputs) -> DataFrame:
    return quality.unknown_items(t.items, _sloppy(t)).select("rfq_id", "supplier", "item_id", "rows")


@query("validate_rfq", f"""WITH s AS ({_SLOPPY_SQL}), q AS (SELECT rfq_id, supplier, trim(item_id) AS item_id,
        count(*) AS n FROM s GROUP BY rfq_id, supplier, trim(item_id)),
    cat AS (SELECT rfq_id, trim(item_id) AS item_id, count(*) AS n FROM (SELECT DISTINCT rfq_id, item_id FROM s)
        GROUP BY rfq_id, trim(item_id)),
    sup AS (SELECT DISTINCT rfq_id, supplier FROM s)
    SELECT rfq_id, 'itens_sem_id' AS code, 'Itens sem identificador' AS title, NULL AS supplier,
        NULL AS item_id, n AS rows FROM cat WHERE item_id = ''
    UNION ALL SELECT rfq_id, 'ids_duplicados', 'Identificadores duplicados', NULL, item_id, n FROM cat
        WHERE item_id <> '' AND n > 1
    UNION ALL SELECT rfq_id, 'fornecedor_sem_nome', 'Fornecedor sem nome', NULL, NULL, 1 FROM sup WHERE supplier IS NULL
    UNION ALL SELECT rfq_id, 'propostas_duplicadas', 'Propostas duplicadas', supplier, item_id, n FROM q WHERE n > 1
    UNION ALL SELECT q.rfq_id, 'ids_inexistentes', 'Itens fora do catálogo', supplier, q.item_id, q.n FROM q
        LEFT JOIN items i ON q.rfq_id = i.rfq_id AND q.item_id = i.item_id
        WHERE i.item_id IS NULL AND q.item_id NOT IN (SELECT item_id FROM cat c WHERE c.rfq_id = q.rfq_id)""")
def validate_rfq(t: Inputs) -> DataFrame:
    rows = _sloppy(t)
    return quality.validate_rfq(rows.select("rfq_id", "item_id").distinct(), rows,
                                rows.select("rfq_id", "supplier").distinct())


def _first_ten(cond: str, source: str) -> str:
    return f"""SELECT rfq_id, max(total) AS total, string_agg(cast(source_row AS varchar), ', ' ORDER BY source_row) AS first_rows
        FROM (SELECT rfq_id, source_row, count(*) OVER (PARTITION BY rfq_id) AS total,
              row_number() OVER (PARTITION BY rfq_id ORDER BY source_row) AS n FROM {source} WHERE {cond})
        WHERE n <= 10 GROUP BY rfq_id"""


@query("import_warnings", f"""SELECT rfq_id, 'totals' AS kind, total AS rows, concat(total,
    ' total(is) informado(s) divergem de quantidade x preço unitário acima da tolerância de 1% (linhas: ', first_rows, ').') AS message
    FROM ({_first_ten("abs(total_price - quantity * unit_price) > greatest(abs(quantity * unit_price) * 0.01, 0.01)", "lines")})
    UNION ALL SELECT rfq_id, 'invalid', total, concat(total,
    ' registro(s) com dados obrigatórios inválidos foram ignorados (linhas: ', first_rows, ').')
    FROM ({_first_ten("1 = 1", "bad")})
    UNION ALL SELECT rfq_id, 'duplicates', n, concat(n,
    ' proposta(s) duplicada(s) para o mesmo produto e fornecedor foram descartadas; foi mantida a menor cotação válida.')
    FROM (SELECT rfq_id, count(*) AS n FROM ({_DUP}) GROUP BY rfq_id)""")
def import_warnings(t: Inputs) -> DataFrame:
    return quality.import_warnings(t.lines, t.chain.valid, t.chain.cheapest)


# --- identity ------------------------------------------------------------------------

_RELIABLE = """SELECT rfq_id, count(quote_code) AS codes, count(DISTINCT quote_code) AS distinct_codes,
    count(DISTINCT description) AS distinct_descriptions,
    count(quote_code) = 0 OR (count(DISTINCT quote_code) * 1.0 / count(quote_code) >= 0.75
        AND count(DISTINCT quote_code) > count(DISTINCT description)) AS unreliable FROM good GROUP BY rfq_id"""


@query("quote_id_reliability", _RELIABLE)
def quote_id_reliability(t: Inputs) -> DataFrame:
    return ident.quote_id_reliability(quality.valid_rows(t.plain))


@query("composite_item_key", """SELECT item_key, count(*) AS n FROM (SELECT concat(trim(description), ' [',
    upper(trim(unit)), ']') AS item_key FROM good) GROUP BY item_key""")
def composite_item_key(t: Inputs) -> DataFrame:
    key = ident.composite_item_key(F.col("description"), F.col("unit"))
    return (quality.valid_rows(t.plain).groupBy(key.alias("item_key"))
            .agg(F.count(F.lit(1)).alias("n")))


_SUFFIXED = """SELECT rfq_id, source_row, description, unit, CASE WHEN count(*) OVER (PARTITION BY rfq_id, quote_code) > 1
    THEN concat(quote_code, '-L', source_row) ELSE quote_code END AS item_id FROM good"""


@query("suffix_repeated_codes", f"SELECT rfq_id, source_row, item_id FROM ({_SUFFIXED})")
def suffix_repeated_codes(t: Inputs) -> DataFrame:
    return ident.suffix_repeated_codes(t.chain.valid).select("rfq_id", "source_row", "item_id")


@query("item_ids_from_codes", f"""SELECT s.rfq_id, s.source_row, CASE WHEN r.unreliable
    THEN concat(trim(s.description), ' [', upper(trim(s.unit)), ']') ELSE s.item_id END AS item_id
    FROM ({_SUFFIXED}) s JOIN ({_RELIABLE}) r ON s.rfq_id = r.rfq_id""")
def item_ids_from_codes(t: Inputs) -> DataFrame:
    return ident.item_ids_from_codes(t.chain.valid, t.hot.rfq).select("rfq_id", "source_row", "item_id")


@query("canonical_suppliers", "SELECT rfq_id, source_row, supplier_key, supplier FROM named")
def canonical_suppliers(t: Inputs) -> DataFrame:
    return _named(t).select("rfq_id", "source_row", "supplier_key", "supplier")


@query("dedup_cheapest", """SELECT rfq_id, item_id, supplier_key, source_row, price_cents FROM kept""")
def dedup_cheapest(t: Inputs) -> DataFrame:
    return t.chain.cheapest.select("rfq_id", "item_id", "supplier_key", "source_row", "price_cents")


@query("distinct_items", """SELECT rfq_id, item_id, description, quantity, unit FROM (SELECT *, row_number() OVER (
    PARTITION BY rfq_id, item_id ORDER BY source_row) AS first FROM kept) WHERE first = 1""")
def distinct_items(t: Inputs) -> DataFrame:
    return ident.distinct_items(t.chain.cheapest)


@query("terms_per_supplier", """SELECT rfq_id, supplier, payment, delivery, min_order, freight, validity, observation
    FROM terms""")
def terms_per_supplier(t: Inputs) -> DataFrame:
    return ident.terms_per_supplier(t.chain.kept)


# --- joins and equalization ----------------------------------------------------------


@query("quote_grid", """SELECT g.rfq_id, g.item_id, g.supplier, k.price_cents, k.rfq_id IS NOT NULL AS quoted
    FROM grid g LEFT JOIN kept k ON g.rfq_id = k.rfq_id AND g.item_id = k.item_id AND g.supplier = k.supplier""")
def quote_grid(t: Inputs) -> DataFrame:
    cells = eq.quote_grid(t.items.select("rfq_id", "item_id"), t.chain.kept, t.chain.suppliers, ["price_cents"], t.hot.rfq)
    return cells.select("rfq_id", "item_id", "supplier", "price_cents", F.col("has_offer").alias("quoted"))


@query("not_quoted", """SELECT g.rfq_id, g.item_id, g.supplier FROM grid g LEFT JOIN kept k ON g.rfq_id = k.rfq_id
    AND g.item_id = k.item_id AND g.supplier = k.supplier WHERE k.rfq_id IS NULL""")
def not_quoted(t: Inputs) -> DataFrame:
    return eq.not_quoted(t.items, t.chain.kept, t.chain.suppliers, t.hot.rfq)


@query("join_terms", """SELECT k.rfq_id, k.item_id, k.supplier, t.payment_days, t.delivery_days, t.no_min_order,
    t.freight_included, t.freight_informed FROM kept k LEFT JOIN indicators t
    ON k.rfq_id = t.rfq_id AND k.supplier = t.supplier""")
def join_terms(t: Inputs) -> DataFrame:
    quotes = t.chain.cheapest.select("rfq_id", "item_id", "supplier_key")
    dim = t.chain.suppliers.select("rfq_id", "supplier_key", "supplier", "payment_days", "delivery_days",
                                   "no_min_order", "freight_included", "freight_informed")
    return eq.join_terms(quotes, dim, t.hot.supplier, "supplier_key").drop("supplier_key")


_CHECK = "SELECT rfq_id, item_id, supplier, {} FROM {}"


@query("quantity_check", _CHECK.format("qty_check", "pairs"))
def quantity_check(t: Inputs) -> DataFrame:
    return t.chain.cells(False).select("rfq_id", "item_id", "supplier", "qty_check")


@query("unit_check", _CHECK.format("unit_check", "pairs"))
def unit_check(t: Inputs) -> DataFrame:
    return t.chain.cells(False).select("rfq_id", "item_id", "supplier", "unit_check")


def _label(a: str) -> str:
    return f"""CASE WHEN r_{a} IS NULL AND q_{a} IS NULL THEN 'NÃO INFORMADO'
        WHEN r_{a} IS NULL THEN 'INFORMADO PELO FORNECEDOR' WHEN q_{a} IS NULL THEN 'NÃO INFORMADO PELO FORNECEDOR'
        WHEN r_{a} = q_{a} THEN 'OK' ELSE 'DIVERGENTE' END AS attr_{a}"""


@query("compare_attributes", f"""SELECT DISTINCT req_description, description, attr_evaluated,
    attr_evaluated - attr_divergences AS attr_compatible, attr_divergences,
    CASE WHEN attr_evaluated = 0 THEN 100.0
         ELSE round((attr_evaluated - attr_divergences) * 100.0 / attr_evaluated, 4) END AS attr_pct,
    {', '.join(_label(a) for a in eq.ATTRIBUTES)} FROM pairs""")
def compare_attributes(t: Inputs) -> DataFrame:
    pairs = (t.chain.cheapest.join(t.items.select("rfq_id", "item_id", F.col("description").alias(
        "requested")), ["rfq_id", "item_id"])
        .select(F.col("requested").alias("req_description"), "description").distinct())
    pairs = text.add_normalized(text.add_normalized(pairs, "req_description", "a"), "description", "b")
    pairs = (pairs.withColumn("x", text.extract_attributes(F.col("a")))
             .withColumn("y", text.extract_attributes(F.col("b"))))
    facts = eq.compare_attributes(F.col("x"), F.col("y"))
    return rounded(pairs.select("req_description", "description",
                                *[v.alias(k) for k, v in facts.items()]), "attr_pct")


@query("eq_status", """SELECT rfq_id, item_id, supplier, eq_status FROM full_statuses""")
def eq_status(t: Inputs) -> DataFrame:
    return t.chain.cells().select("rfq_id", "item_id", "supplier", "eq_status")


@query("equalize", """SELECT g.rfq_id, g.item_id, g.supplier, g.req_description, c.description, g.req_quantity, c.quantity,
    g.req_unit, c.unit, c.unit_price, coalesce(round(c.similarity, 4), 0.0) AS similarity,
    CASE WHEN c.rfq_id IS NULL THEN 0.0 WHEN attr_evaluated = 0 THEN 100.0
         ELSE round((attr_evaluated - attr_divergences) * 100.0 / attr_evaluated, 4) END AS attr_pct,
    coalesce(attr_divergences, 0) AS attr_divergences, coalesce(qty_check, 'NÃO COTADO') AS qty_check,
    coalesce(unit_check, 'NÃO COTADO') AS unit_check, coalesce(eq_status, 'NÃO COTADO') AS eq_status
    FROM grid g LEFT JOIN full_statuses c ON g.rfq_id = c.rfq_id AND g.item_id = c.item_id AND g.supplier = c.supplier""")
def equalize(t: Inputs) -> DataFrame:
    return rounded(t.chain.grid, "similarity", "attr_pct")


# --- scores and recommendation -------------------------------------------------------


@query("commercial_indicators", """SELECT rfq_id, supplier, payment, payment_days, delivery, delivery_days, min_order,
    no_min_order, freight, freight_included, freight_informed, validity FROM indicators""")
def commercial_indicators(t: Inputs) -> DataFrame:
    return t.chain.suppliers.select(
        "rfq_id", "supplier", "payment", "payment_days", "delivery", "delivery_days", "min_order",
        "no_min_order", "freight", "freight_included", "freight_informed", "validity")


def _scored(t: Inputs, *columns: str) -> DataFrame:
    return t.chain.scored().select("rfq_id", "item_id", "supplier", *columns)


@query("price_eligible", _CHECK.format("price_eligible", "cells"))
def price_eligible(t: Inputs) -> DataFrame:
    return t.chain.eligible_cells.select("rfq_id", "item_id", "supplier", "price_eligible")


@query("eligible", _CHECK.format("eligible", "cells"))
def eligible(t: Inputs) -> DataFrame:
    return t.chain.eligible_cells.select("rfq_id", "item_id", "supplier", "eligible")


def _round_check(column: str, source: str) -> str:
    return _CHECK.format(f"round({column}, 4) AS {column}", source)


@query("price_score", _round_check("price_score", "part_scores"))
def price_score(t: Inputs) -> DataFrame:
    return rounded(_scored(t, "price_score"), "price_score")


@query("sim_attr_scores", _CHECK.format("sim_score, attr_score", "part_scores"))
def sim_attr_scores(t: Inputs) -> DataFrame:
    return _scored(t, "sim_score", "attr_score")


@query("payment_score", _round_check("payment_score", "part_scores"))
def payment_score(t: Inputs) -> DataFrame:
    return rounded(_scored(t, "payment_score"), "payment_score")


@query("delivery_score", _round_check("delivery_score", "part_scores"))
def delivery_score(t: Inputs) -> DataFrame:
    return rounded(_scored(t, "delivery_score"), "delivery_score")


@query("freight_score", _CHECK.format("freight_score", "part_scores"))
def freight_score(t: Inputs) -> DataFrame:
    return _scored(t, "freight_score")


@query("commercial_score", _round_check("commercial_score", "commercial"))
def commercial_score(t: Inputs) -> DataFrame:
    return rounded(_scored(t, "commercial_score"), "commercial_score")


@query("final_score", _round_check("final_score", "finals"))
def final_score(t: Inputs) -> DataFrame:
    return rounded(_scored(t, "final_score"), "final_score")


@query("score_class", _CHECK.format("score_class", "ranked"))
def score_class(t: Inputs) -> DataFrame:
    return _scored(t, "score_class")


@query("rank_suppliers", _CHECK.format(
    "cast(CASE WHEN eligible THEN place END AS bigint) AS rank, round(final_score, 4) AS final_score", "ranked"))
def rank_suppliers(t: Inputs) -> DataFrame:
    ranked = scoring.rank_suppliers(t.chain.scored(), t.hot.item)
    return rounded(ranked.select("rfq_id", "item_id", "supplier", "rank", "final_score"), "final_score")


@query("recommend", """SELECT rfq_id, item_id, winner, round(final_score, 4) AS final_score,
    round(unit_price, 4) AS unit_price, score_class FROM winners""")
def recommend(t: Inputs) -> DataFrame:
    return rounded(t.chain.recommendations.select(
        "rfq_id", "item_id", "winner", "final_score", "unit_price", "score_class"),
        "final_score", "unit_price")


@query("technical_tie", """SELECT i.rfq_id, i.item_id, coalesce(t.n, 0) > 1 AS technical_tie,
    coalesce(t.names, '') AS tied_suppliers FROM items i LEFT JOIN ties t
    ON i.rfq_id = t.rfq_id AND i.item_id = t.item_id""")
def technical_tie(t: Inputs) -> DataFrame:
    return t.chain.recommendations.select(
        "rfq_id", "item_id", "technical_tie", F.array_join("tied_suppliers", ", ").alias("tied_suppliers"))


@query("reason_text", """SELECT w.rfq_id, w.item_id, CASE WHEN winner = 'NENHUM'
    THEN 'Nenhum fornecedor atende aos critérios mínimos.' ELSE concat_ws(', ',
    CASE WHEN abs(price_score - 100) <= 0.00100001 THEN 'menor preço' WHEN price_score >= 90 THEN 'preço muito competitivo' END,
    'descrição equivalente', 'atributos equivalentes',
    CASE WHEN commercial_score >= 90 THEN 'excelentes condições comerciais'
         WHEN commercial_score >= 70 THEN 'condições comerciais adequadas' END,
    CASE WHEN t.n > 1 THEN concat('empate técnico: ', t.names) END) END AS reason
    FROM winners w LEFT JOIN ties t ON w.rfq_id = t.rfq_id AND w.item_id = t.item_id""")
def reason_text(t: Inputs) -> DataFrame:
    return t.chain.recommendations.select("rfq_id", "item_id", "reason")


# --- comparison and summaries --------------------------------------------------------


@query("comparative_map", """SELECT rfq_id, item_id, description, quantity, unit, round(min_price, 4) AS min_price,
    round(max_price, 4) AS max_price, round(spread_pct, 4) AS spread_pct, best_suppliers, divergent, not_quoted FROM cmap""")
def comparative_map(t: Inputs) -> DataFrame:
    out = t.cmap.withColumn("best_suppliers", F.array_join("best_suppliers", ", "))
    return rounded(out, "min_price", "max_price", "spread_pct")


@query("comparative_map_wide", """SELECT rfq_id, item_id, string_agg(supplier || '=' || cents, '; ' ORDER BY supplier) AS prices
    FROM (SELECT rfq_id, item_id, supplier, cast(round(max(unit_price) * 100) AS bigint) AS cents FROM cells
          WHERE price_eligible GROUP BY rfq_id, item_id, supplier) GROUP BY rfq_id, item_id""")
def comparative_map_wide(t: Inputs) -> DataFrame:
    """Eligible prices of every request as one map for each item, shown as text in cents."""
    entry = lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 100).cast("bigint").cast("string"))
    return analysis.price_maps(t.marked).select("rfq_id", "item_id", F.array_join(
        F.transform(F.array_sort(F.map_entries("prices")), entry), "; ").alias("prices"))


@query("supplier_summary", """SELECT rfq_id, supplier, quoted, not_quoted, equivalent, divergent, eligible_prices,
    lowest_prices, round(lowest_pct, 4) AS lowest_pct, round(eligible_total, 2) AS eligible_total FROM summary""")
def supplier_summary(t: Inputs) -> DataFrame:
    return rounded(rounded(t.summary, "lowest_pct"), "eligible_total", digits=2)


@query("kpis", """SELECT rfq_id, items, suppliers, items_with_price, items_without_price, items_divergent, items_not_quoted,
    round(max_spread_pct, 4) AS max_spread_pct, leader, leader_lowest_prices FROM figures""")
def kpis(t: Inputs) -> DataFrame:
    return rounded(analysis.kpis(t.cmap, t.summary), "max_spread_pct")


_MISSING = """SELECT g.* FROM grid g LEFT JOIN (SELECT * FROM cells WHERE eq_status <> 'NÃO COTADO') c
    ON g.rfq_id = c.rfq_id AND g.item_id = c.item_id AND g.supplier = c.supplier WHERE c.rfq_id IS NULL"""


def _amount_sql(q: str, unit: str) -> str:
    return f"concat_ws(' ', cast({q} AS varchar), {unit})"


@query("alerts", f"""SELECT rfq_id, 'ALTA' AS priority, 'Divergência' AS kind, item_id, req_description AS description,
        req_quantity AS quantity, req_unit AS unit, supplier, concat(supplier, ' apresenta ', lower(eq_status), ' no item ', item_id,
        ' (', req_description, '): ', {_amount_sql('req_quantity', 'req_unit')}, '.') AS message FROM cells
        WHERE eq_status IN ('DIVERGÊNCIA', 'DIVERGÊNCIA ESTRUTURAL')
    UNION ALL SELECT rfq_id, 'ALTA', 'Não cotado', item_id, req_description, req_quantity, req_unit, supplier,
        concat(supplier, ' não cotou o item ', item_id, ' (', req_description, '), quantidade ',
        {_amount_sql('req_quantity', 'req_unit')}, '.') FROM ({_MISSING})
    UNION ALL SELECT rfq_id, 'MÉDIA', 'Diferença de preço', item_id, description, quantity, unit, NULL,
        concat('O item ', item_id, ' (', description, '), quantidade ', {_amount_sql('quantity', 'unit')},
        ', apresenta diferença de ', printf('%.2f', spread_pct), '% entre preços elegíveis.') FROM cmap WHERE spread_pct >= 30
    UNION ALL SELECT rfq_id, 'MÉDIA', 'Pedido mínimo', NULL, NULL, NULL, NULL, supplier,
        concat(supplier, ' possui pedido mínimo informado: ', min_order, '.') FROM indicators WHERE NOT no_min_order
    UNION ALL SELECT rfq_id, 'MÉDIA', 'Frete', NULL, NULL, NULL, NULL, supplier,
        concat(supplier, ' não apresenta frete incluso (', freight, ').') FROM indicators WHERE freight_informed AND NOT freight_included
    UNION ALL SELECT rfq_id, 'BAIXA', 'Frete', NULL, NULL, NULL, NULL, supplier,
        concat(supplier, ' não informou a condição de frete.') FROM indicators WHERE NOT freight_informed""")
def alerts(t: Inputs) -> DataFrame:
    return analysis.alerts(t.items, t.marked, t.chain.suppliers, t.cmap, t.hot.rfq)


@query("insights", """WITH sp AS (SELECT rfq_id, item_id, spread_pct, row_number() OVER (PARTITION BY rfq_id
        ORDER BY spread_pct DESC, item_id) AS n FROM cmap WHERE spread_pct IS NOT NULL),
    pay AS (SELECT rfq_id, supplier, payment_days AS d, row_number() OVER (PARTITION BY rfq_id
        ORDER BY payment_days DESC, supplier) AS n FROM indicators WHERE payment_days IS NOT NULL),
    del AS (SELECT rfq_id, supplier, delivery_days AS d, row_number() OVER (PARTITION BY rfq_id
        ORDER BY delivery_days, supplier) AS n FROM indicators WHERE delivery_days IS NOT NULL)
    SELECT rfq_id, 0 AS position, concat('A cotação possui ', items, ' itens e ', suppliers,
        ' fornecedores participantes.') AS insight FROM figures
    UNION ALL SELECT rfq_id, 1, CASE WHEN items_divergent > 0 THEN concat('Foram identificados ', items_divergent,
        ' item(ns) com divergências.') ELSE 'Não foram identificadas divergências.' END FROM figures
    UNION ALL SELECT rfq_id, 2, concat('Existem ', items_not_quoted, ' item(ns) não cotados por pelo menos um fornecedor.')
        FROM figures WHERE items_not_quoted > 0
    UNION ALL SELECT rfq_id, 3, concat('A maior diferença de preço entre propostas elegíveis foi de ',
        printf('%.2f', spread_pct), '% no item ', item_id, '.') FROM sp WHERE n = 1
    UNION ALL SELECT rfq_id, 4, concat(supplier, ' apresenta o maior prazo de pagamento identificado: ',
        cast(d AS bigint), ' dias.') FROM pay WHERE n = 1
    UNION ALL SELECT rfq_id, 5, concat(supplier, ' apresenta o menor prazo de entrega identificado: ',
        cast(d AS bigint), ' dias.') FROM del WHERE n = 1""")
def insights(t: Inputs) -> DataFrame:
    return analysis.insights(analysis.kpis(t.cmap, t.summary), t.cmap, t.chain.suppliers)


@query("executive_summary", """SELECT c.rfq_id, count(*) AS items, max(s.n) AS suppliers,
    count(*) FILTER (WHERE divergent > 0) AS items_divergent, count(*) FILTER (WHERE not_quoted > 0) AS items_not_quoted,
    round(coalesce(sum((max_price - min_price) * quantity), 0), 2) AS potential_saving,
    round(coalesce(sum(min_price * quantity), 0), 2) AS lowest_cost
    FROM cmap c LEFT JOIN (SELECT rfq_id, count(*) AS n FROM sellers GROUP BY rfq_id) s ON c.rfq_id = s.rfq_id
    GROUP BY c.rfq_id""")
def executive_summary(t: Inputs) -> DataFrame:
    return analysis.executive_summary(t.cmap, t.sellers)


@query("value_ranking", """SELECT rfq_id, supplier, round(eligible_total, 2) AS eligible_total,
    row_number() OVER (PARTITION BY rfq_id ORDER BY round(eligible_total, 6), supplier) AS position FROM summary""")
def value_ranking(t: Inputs) -> DataFrame:
    totals = rounded(t.summary, "eligible_total", digits=6)
    return rounded(analysis.value_ranking(totals, t.hot.rfq), "eligible_total", digits=2)


# --- source analysis -----------------------------------------------------------------


def _list_sql(c: str) -> str:
    return f"coalesce(string_agg(DISTINCT nullif(trim({c}), ''), ', ' ORDER BY nullif(trim({c}), '')), '')"


@query("product_rollup", f"""SELECT rfq_id, trim(coalesce(description, 'Sem descrição')) AS product,
    {_list_sql('category')} AS categories, count(*) AS quotes, count(DISTINCT supplier) AS suppliers,
    sum(quantity) AS total_quantity, round(min(unit_price), 6) AS min_price, round(avg(unit_price), 6) AS avg_price,
    round(max(unit_price), 6) AS max_price, {_list_sql('unit')} AS units, {_list_sql('currency')} AS currencies,
    {_list_sql('status')} AS statuses, {_list_sql('delivery')} AS deliveries,
    CASE WHEN min(unit_price) > 0 THEN round((max(unit_price) - min(unit_price)) / min(unit_price) * 100, 2) END AS variation_pct
    FROM kept GROUP BY rfq_id, trim(coalesce(description, 'Sem descrição'))""")
def product_rollup(t: Inputs) -> DataFrame:
    return rounded(prof.product_rollup(t.chain.kept), "min_price", "avg_price", "max_price", digits=6)


@query("supplier_rollup", f"""SELECT rfq_id, supplier, count(DISTINCT description) AS products, count(*) AS quotes,
    round(min(unit_price), 6) AS min_price, round(avg(unit_price), 6) AS avg_price, round(max(unit_price), 6) AS max_price,
    {_list_sql('category')} AS categories, {_list_sql('currency')} AS currencies, {_list_sql('status')} AS statuses,
    {_list_sql('delivery')} AS deliveries FROM kept GROUP BY rfq_id, supplier""")
def supplier_rollup(t: Inputs) -> DataFrame:
    return rounded(prof.supplier_rollup(t.chain.kept), "min_price", "avg_price", "max_price", digits=6)


@query("join_unique", f"""SELECT rfq_id, {_list_sql('currency')} AS currencies, {_list_sql('unit')} AS units,
    {_list_sql('status')} AS statuses FROM lines GROUP BY rfq_id""")
def join_unique(t: Inputs) -> DataFrame:
    return t.plain.groupBy("rfq_id").agg(
        prof.join_unique("currency").alias("currencies"), prof.join_unique("unit").alias("units"),
        prof.join_unique("status").alias("statuses"))


_PROFILE = """SELECT p.rfq_id, p.physical_rows, coalesce(u.valid_rows, 0) AS used_rows,
    p.physical_rows - coalesce(u.valid_rows, 0) AS discarded_rows, u.valid_rows, u.products, u.suppliers,
    u.with_price, u.without_price, u.with_delivery, u.with_status, u.with_currency
    FROM (SELECT rfq_id, count(*) AS physical_rows FROM lines GROUP BY rfq_id) p
    JOIN (SELECT rfq_id, count(*) AS valid_rows, count(DISTINCT description) AS products,
        count(DISTINCT supplier) AS suppliers, count(unit_price) AS with_price,
        count(*) - count(unit_price) AS without_price, count(delivery) AS with_delivery,
        count(status) AS with_status, count(currency) AS with_currency FROM kept GROUP BY rfq_id) u
    ON p.rfq_id = u.rfq_id"""


def _profile(t: Inputs) -> DataFrame:
    chain = t.chain.written(["rfq_id", "source_row", *quality.REQUIRED, "total_price", "delivery", "status", "currency"])
    counts = quality.row_counts(chain.quotes, chain.cheapest)
    notes = quality.import_warnings(chain.quotes, chain.valid, chain.cheapest)
    return prof.quality_profile(chain.kept, counts, notes)


@query("quality_profile", f"""SELECT p.*, (SELECT count(*) FROM (SELECT DISTINCT rfq_id FROM bad) b WHERE b.rfq_id = p.rfq_id)
    + (SELECT count(*) FROM (SELECT DISTINCT rfq_id FROM ({_DUP})) d WHERE d.rfq_id = p.rfq_id)
    + (SELECT count(*) FROM (SELECT DISTINCT rfq_id FROM lines WHERE abs(total_price - quantity * unit_price)
        > greatest(abs(quantity * unit_price) * 0.01, 0.01)) m WHERE m.rfq_id = p.rfq_id) AS warnings
    FROM ({_PROFILE}) p""")
def quality_profile(t: Inputs) -> DataFrame:
    return _profile(t)


@query("source_type", f"""SELECT rfq_id, CASE WHEN products < valid_rows THEN 'Exportação bruta de cotações'
    ELSE 'Base tabular de propostas' END AS source_type FROM ({_PROFILE})""")
def source_type(t: Inputs) -> DataFrame:
    return prof.source_type(_profile(t))


@query("default_labels", """SELECT supplier, description, count(*) AS n FROM (SELECT
    coalesce(CASE WHEN l_suppkey % 61 = 60 THEN NULL ELSE s_name END, 'Sem fornecedor') AS supplier,
    coalesce(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END, 'Sem descrição') AS description
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
    GROUP BY supplier, description""")
def default_labels(t: Inputs) -> DataFrame:
    rows = (t.table("lineitem").join(t.table("part"), F.expr("l_partkey = p_partkey"))
            .join(t.table("supplier"), F.expr("l_suppkey = s_suppkey"))
            .select(F.expr(_SLOPPY["supplier"]).alias("supplier"),
                    F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END").alias("description")))
    return (prof.default_labels(rows).groupBy("supplier", "description")
            .agg(F.count(F.lit(1)).alias("n")))


# --- views ---------------------------------------------------------------------------


@query("compact_map", """SELECT g.rfq_id, g.item_id, g.req_description AS description, g.req_quantity AS quantity,
    g.req_unit AS unit, g.supplier, round(CASE WHEN c.price_eligible THEN c.unit_price END, 4) AS price,
    coalesce(f.eq_status, 'NÃO COTADO') AS status, m.best_suppliers,
    CASE WHEN b.rfq_id IS NULL THEN '' ELSE 'Melhor preço' END AS note
    FROM grid g LEFT JOIN full_statuses f ON g.rfq_id = f.rfq_id AND g.item_id = f.item_id AND g.supplier = f.supplier
    LEFT JOIN cells c ON g.rfq_id = c.rfq_id AND g.item_id = c.item_id AND g.supplier = c.supplier
    LEFT JOIN cmap m ON g.rfq_id = m.rfq_id AND g.item_id = m.item_id
    LEFT JOIN best b ON g.rfq_id = b.rfq_id AND g.item_id = b.item_id AND g.supplier = b.supplier""")
def compact_map(t: Inputs) -> DataFrame:
    from bidframe.plans.report import map_grid
    out = views.compact_map(map_grid(t))
    return rounded(out.withColumn("best_suppliers", F.array_join("best_suppliers", ", ")), "price")


@query("prices_long", """SELECT rfq_id, item_id, req_description AS description, supplier, round(unit_price, 4) AS price
    FROM cells WHERE price_eligible""")
def prices_long(t: Inputs) -> DataFrame:
    return rounded(views.prices_long(t.chain.eligible_cells), "price")


_KPI_NAMES = ("items", "items_with_price", "items_without_price", "items_divergent", "items_not_quoted",
              "suppliers", "leader", "leader_lowest_prices")


@query("kpi_rows", " UNION ALL ".join(
    [f"SELECT rfq_id, '{n}' AS indicator, cast({n} AS varchar) AS value FROM figures" for n in _KPI_NAMES]
    + ["SELECT rfq_id, 'max_spread_pct', cast(round(max_spread_pct, 2) AS varchar) FROM figures"]))
def kpi_rows(t: Inputs) -> DataFrame:
    return views.kpi_rows(rounded(analysis.kpis(t.cmap, t.summary), "max_spread_pct", digits=2)
                          .select("rfq_id", *_KPI_NAMES, "max_spread_pct"))


@query("severity_band", """SELECT r.rfq_id, r.item_id, r.supplier,
    CASE WHEN f.eq_status IN ('NÃO COTADO', 'DIVERGÊNCIA', 'DIVERGÊNCIA ESTRUTURAL', 'DIVERGENTE') THEN 'bad'
         WHEN f.eq_status = 'EQUIVALENTE COM REVISÃO' THEN 'medium' WHEN f.eq_status = 'EQUIVALENTE' THEN 'good' END AS status_band,
    CASE WHEN r.qty_check = 'OK' THEN 'good' ELSE 'bad' END AS qty_band,
    CASE WHEN score_class = 'NÃO RECOMENDADO' THEN 'bad' WHEN score_class = 'EXCELENTE' THEN 'good' ELSE 'medium' END AS class_band,
    CASE WHEN final_score >= 90 THEN 'good' WHEN final_score >= 60 THEN 'medium' ELSE 'plain' END AS score_band,
    CASE WHEN spread_pct <= 5 THEN 'good' WHEN spread_pct <= 15 THEN 'medium' WHEN spread_pct IS NOT NULL THEN 'bad' END AS spread_band,
    CASE WHEN eligible THEN 'good' ELSE 'bad' END AS eligible_band
    FROM ranked r JOIN full_statuses f ON r.rfq_id = f.rfq_id AND r.item_id = f.item_id AND r.supplier = f.supplier
    LEFT JOIN cmap m ON r.rfq_id = m.rfq_id AND r.item_id = m.item_id""")
def severity_band(t: Inputs) -> DataFrame:
    """Bands of every scored cell and of its item's spread. The cells are written once, marked, for the map and the bands."""
    cells = analysis.mark_best(t.chain.scored(exact_similarity=True), t.hot.item)
    bands = {"status_band": views.status_band(F.col("eq_status")), "qty_band": views.status_band(F.col("qty_check")),
             "class_band": views.class_band(F.col("score_class")), "score_band": views.score_band(F.col("final_score")),
             "eligible_band": views.eligible_band(F.col("eligible"))}
    cells = staged(cells.select("rfq_id", "item_id", "supplier", "eq_status", "price_eligible", "unit_price", "is_best",
                                *[band.alias(name) for name, band in bands.items()]))
    t = Inputs(t.spark, t.sf_dir)
    t.__dict__["marked"] = cells
    spread = t.cmap.select("rfq_id", "item_id", "spread_pct")
    return (cells.select("rfq_id", "item_id", "supplier", *bands).join(spread, ["rfq_id", "item_id"], "left")
            .select("rfq_id", "item_id", "supplier", "status_band", "qty_band", "class_band", "score_band",
                    views.spread_band(F.col("spread_pct")).alias("spread_band"), "eligible_band"))


def _top_sql(select: str, source: str, order: str, n: int, where: str = "1 = 1") -> str:
    return f"""SELECT {select}, position FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY {order}) AS position
        FROM {source} WHERE {where}) WHERE position <= {n}"""


@query("top_spread", _top_sql("rfq_id, item_id, description, round(spread_pct, 4) AS spread_pct", "cmap",
                              "spread_pct DESC, item_id", 8, "spread_pct IS NOT NULL"))
def top_spread(t: Inputs) -> DataFrame:
    return rounded(views.top_spread(t.cmap), "spread_pct")


@query("supplier_value_chart", _top_sql("rfq_id, supplier, round(eligible_total, 2) AS eligible_total", "summary",
                                        "round(eligible_total, 6), supplier", 8, "eligible_total > 0"))
def supplier_value_chart(t: Inputs) -> DataFrame:
    totals = rounded(t.summary, "eligible_total", digits=6)
    return rounded(views.supplier_value_chart(totals), "eligible_total", digits=2)


@query("supplier_wins_chart", _top_sql("rfq_id, supplier, lowest_prices", "summary",
                                       "lowest_prices DESC, supplier", 8))
def supplier_wins_chart(t: Inputs) -> DataFrame:
    return views.supplier_wins_chart(t.summary)


@query("delivery_chart", _top_sql("rfq_id, supplier, delivery_days", "indicators",
                                  "delivery_days, supplier", 8, "delivery_days IS NOT NULL"))
def delivery_chart(t: Inputs) -> DataFrame:
    return views.delivery_chart(t.chain.suppliers)


@query("top_products", _top_sql("rfq_id, product, quotes", """(SELECT rfq_id, trim(description) AS product,
    count(*) AS quotes FROM kept GROUP BY rfq_id, trim(description))""", "quotes DESC, product", 20))
def top_products(t: Inputs) -> DataFrame:
    return views.top_products(prof.product_rollup(t.chain.kept)).select("rfq_id", "product", "quotes", "position")
