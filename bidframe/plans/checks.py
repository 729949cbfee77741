"""Shared building blocks of the checking SQL."""
from __future__ import annotations

from bidframe.plans.registry import CTES
from bidframe.sources import bridge

ACCENTS = ("áàâãäåçéèêëíìîïñóòôõöúùûüýÿºª²³¹", "aaaaaaceeeeiiiinooooouuuuyyoa231")


def strip_sql(x: str) -> str:
    return f"trim({x}, e' \\t\\n\\r')"


def key_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"


def norm_sql(x: str) -> str:
    """Comparable text: accents folded, unit words spelled out, words only."""
    text = f"translate(lower({strip_sql(f'coalesce({x}, {chr(39)*2})')}), '{ACCENTS[0]}', '{ACCENTS[1]}')"
    text = f"replace({text}, '…', '...')"
    for pattern, word in (("unid|un", "unidade"), ("pcs|pc", "peca"),
                          ("caixas|caix", "caixa"), ("pcts|pct", "pacote")):
        text = f"regexp_replace({text}, '\\b({pattern})\\b', '{word}', 'g')"
    return f"trim(regexp_replace({text}, '[^a-z0-9.]+', ' ', 'g'))"


def tokens_sql(norm: str) -> str:
    return f"list_distinct(list_filter(string_split({norm}, ' '), lambda t: t <> ''))"


def first_of_sql(norm: str, words) -> str:
    tests = " ".join(f"WHEN regexp_matches({norm}, '\\b{w}\\b') THEN '{w}'" for w in words)
    return f"CASE {tests} END"


COLOURS = ("azul", "preto", "branco", "vermelho", "verde", "amarelo", "rosa", "cinza")
TIPS = ("fina", "media", "grossa")


def attrs_sql(norm: str, prefix: str) -> str:
    """Four attribute columns of a normalized text."""
    size = r"\b(\d+(?:\.\d+)?)\s*(cm|mm|m)\b"
    gram = r"\b(\d+(?:\.\d+)?)\s*g\b"
    return f"""{first_of_sql(norm, COLOURS)} AS {prefix}colour,
        {first_of_sql(norm, TIPS)} AS {prefix}tip,
        CASE WHEN regexp_matches({norm}, '{size}')
             THEN regexp_extract({norm}, '{size}', 1) || ' ' || regexp_extract({norm}, '{size}', 2) END AS {prefix}size,
        CASE WHEN regexp_matches({norm}, '{gram}')
             THEN regexp_extract({norm}, '{gram}', 1) || ' g' END AS {prefix}grammage"""


def days_sql(x: str) -> str:
    text = f"lower({strip_sql(x)})"
    number = rf"regexp_extract({text}, '(\d+([.,]\d+)?)\s*(dias?|d)?\b', 1)"
    return f"""CASE WHEN regexp_matches({text}, 'imediato|imediata|à vista|a vista|avista') THEN 0.0
        WHEN {x} IS NULL OR {number} = '' THEN NULL
        ELSE cast(replace({number}, ',', '.') AS double) END"""


def included_sql(x: str) -> str:
    text = f"lower(coalesce({x}, ''))"
    return (f"(regexp_matches({text}, 'inclus|cif|fornecedor') "
            f"AND NOT regexp_matches({text}, 'não|nao|fob|cliente|comprador'))")


def informed_sql(x: str) -> str:
    return f"(trim(coalesce({x}, '')) <> '')"


def no_min_sql(x: str) -> str:
    text = f"lower(trim(coalesce({x}, '')))"
    return (f"({text} IN ('', '0', '0,00', '0.00') OR regexp_matches({text}, 'sem m[ií]nimo"
            f"|não há|nao ha|não se aplica|nao se aplica|nenhum|isento'))")


_columns = ",\n".join(f"{sql} AS {name}" for name, sql in bridge.COLUMNS.items())
_order = ", ".join(bridge.ROW_ORDER)

CTES["lines"] = f"""SELECT *, price_cents / 100.0 AS unit_price FROM (SELECT {_columns},
    row_number() OVER (PARTITION BY p_brand, p_size ORDER BY {_order}) AS source_row
    FROM {bridge.JOINS})"""

CTES["items"] = """SELECT DISTINCT rfq_id, item_id, req_description AS description,
    req_quantity AS quantity, req_unit AS unit FROM lines"""

CTES["bad"] = """SELECT * FROM lines WHERE description IS NULL OR unit IS NULL OR supplier IS NULL
    OR item_id IS NULL OR quantity IS NULL OR quantity <= 0 OR unit_price IS NULL OR unit_price <= 0"""

CTES["good"] = f"""SELECT *, {key_sql('supplier')} AS supplier_key FROM lines
    WHERE description IS NOT NULL AND unit IS NOT NULL AND supplier IS NOT NULL
    AND item_id IS NOT NULL AND quantity > 0 AND unit_price > 0"""

CTES["first_names"] = """SELECT rfq_id, supplier_key, arg_min(supplier, source_row) AS name
    FROM good GROUP BY rfq_id, supplier_key"""

CTES["named"] = """SELECT g.* EXCLUDE (supplier), n.name AS supplier FROM good g
    JOIN first_names n ON g.rfq_id = n.rfq_id AND g.supplier_key = n.supplier_key"""

CTES["kept"] = """SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY rfq_id, item_id, supplier ORDER BY unit_price, source_row) AS n FROM named) WHERE n = 1"""

CTES["terms"] = """SELECT rfq_id, supplier,
    arg_min(payment, source_row) FILTER (WHERE trim(payment) <> '') AS payment,
    arg_min(delivery, source_row) FILTER (WHERE trim(delivery) <> '') AS delivery,
    arg_min(min_order, source_row) FILTER (WHERE trim(min_order) <> '') AS min_order,
    arg_min(freight, source_row) FILTER (WHERE trim(freight) <> '') AS freight,
    arg_min(validity, source_row) FILTER (WHERE trim(validity) <> '') AS validity,
    arg_min(observation, source_row) FILTER (WHERE trim(observation) <> '') AS observation
    FROM kept GROUP BY rfq_id, supplier"""

CTES["indicators"] = f"""SELECT *, {days_sql('payment')} AS payment_days,
    {days_sql('delivery')} AS delivery_days, {no_min_sql('min_order')} AS no_min_order,
    {included_sql('freight')} AS freight_included, {informed_sql('freight')} AS freight_informed
    FROM terms"""

CTES["item_texts"] = f"""SELECT *, {tokens_sql('norm')} AS r_tokens, {attrs_sql('norm', 'r_')},
    {norm_sql('unit')} AS r_unit FROM (SELECT *, {norm_sql('description')} AS norm FROM items)"""

CTES["quote_texts"] = f"""SELECT *, {tokens_sql('norm')} AS q_tokens, {attrs_sql('norm', 'q_')},
    {norm_sql('unit')} AS q_unit FROM (SELECT *, {norm_sql('description')} AS norm FROM kept)"""


def _divergent(a: str) -> str:
    return f"CASE WHEN r_{a} IS NOT NULL AND (q_{a} IS NULL OR q_{a} <> r_{a}) THEN 1 ELSE 0 END"


_attrs = ("colour", "tip", "size", "grammage")

CTES["pairs"] = f"""SELECT q.rfq_id, q.item_id, q.supplier, i.description AS req_description,
    q.description, i.quantity AS req_quantity, q.quantity, i.unit AS req_unit, q.unit,
    q.unit_price, q.price_cents, r_tokens, q_tokens,
    {', '.join(f'r_{a}, q_{a}' for a in _attrs)},
    {' + '.join(_divergent(a) for a in _attrs)} AS attr_divergences,
    {' + '.join(f'CASE WHEN r_{a} IS NULL THEN 0 ELSE 1 END' for a in _attrs)} AS attr_evaluated,
    CASE WHEN abs(i.quantity - q.quantity) <= greatest(1e-9 * greatest(abs(i.quantity), abs(q.quantity)), 1e-9)
         THEN 'OK' ELSE 'DIVERGENTE' END AS qty_check,
    CASE WHEN r_unit = q_unit THEN 'OK' ELSE 'DIVERGENTE' END AS unit_check,
    list_has_any(r_tokens, q_tokens) AND (list_has_all(r_tokens, q_tokens)
        OR list_has_all(q_tokens, r_tokens)) AS is_full,
    len(r_tokens) = 0 OR len(q_tokens) = 0 OR (NOT list_has_any(r_tokens, q_tokens)
        AND NOT list_has_any(string_split(list_aggregate(r_tokens, 'string_agg', ' '), ''),
                             string_split(list_aggregate(q_tokens, 'string_agg', ' '), ''))) AS is_zero
    FROM quote_texts q JOIN item_texts i ON q.rfq_id = i.rfq_id AND q.item_id = i.item_id"""


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence of two texts of up to 126 characters: bits of a 128-bit number."""
    ones = f"((1::HUGEINT << length({a})) - 1)"
    mask = (f"coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substring({a}, i + 1, 1) = ch "
            f"THEN 1::HUGEINT << i ELSE 0::HUGEINT END)), 0)::HUGEINT")
    steps = f"list_transform(list_filter(string_split({b}, ''), lambda x: x <> ''), lambda ch: {mask})"
    state = (f"list_reduce(list_prepend({ones}, {steps}), "
             f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {ones})")
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count({state}) END"


def joined_sql(tokens: str) -> str:
    return f"coalesce(list_aggregate(list_sort({tokens}), 'string_agg', ' '), '')"


def set_score_sql(s: str, a: str, b: str, common: str) -> str:
    """Token-set similarity from the joined shared and one-sided tokens and the LCS of the latter."""
    n, x, y = f"length({s})", f"length({a})", f"length({b})"
    sep = f"CASE WHEN {n} > 0 THEN 1 ELSE 0 END"
    return f"""CASE WHEN {n} + {x} = 0 OR {n} + {y} = 0 THEN 0.0 WHEN {n} > 0 AND ({x} = 0 OR {y} = 0) THEN 100.0
        ELSE greatest(100.0 - 100.0 * ({x} + {y} - 2 * {common}) / (2 * ({n} + {sep}) + {x} + {y}),
            CASE WHEN {n} > 0 THEN 100.0 - 100.0 * (1 + {x}) / (2 * {n} + 1 + {x}) END,
            CASE WHEN {n} > 0 THEN 100.0 - 100.0 * (1 + {y}) / (2 * {n} + 1 + {y}) END) END"""


def token_scores_sql(source: str, x: str, y: str) -> str:
    """``source`` with ``similarity`` of its token lists ``x`` and ``y``."""
    parts = (f"{joined_sql(f'list_filter({x}, lambda t: list_contains({y}, t))')} AS sim_s, "
             f"{joined_sql(f'list_filter({x}, lambda t: NOT list_contains({y}, t))')} AS sim_a, "
             f"{joined_sql(f'list_filter({y}, lambda t: NOT list_contains({x}, t))')} AS sim_b")
    return (f"SELECT * EXCLUDE (sim_s, sim_a, sim_b, sim_n), {set_score_sql('sim_s', 'sim_a', 'sim_b', 'sim_n')} AS similarity "
            f"FROM (SELECT *, {lcs_sql('sim_a', 'sim_b')} AS sim_n FROM (SELECT *, {parts} FROM {source}))")


# Distinct pairs of requested and quoted text, normalized.
CTES["line_pairs"] = f"""SELECT *, {tokens_sql('a')} AS ta, {tokens_sql('b')} AS tb FROM (
    SELECT req_description, description, {norm_sql('req_description')} AS a, {norm_sql('description')} AS b
    FROM (SELECT DISTINCT req_description, description FROM lines))"""

CTES["line_scores"] = token_scores_sql("line_pairs", "ta", "tb")

# Scores of the quoted cells by their distinct texts; below 100 only these need characters.
CTES["pair_scores"] = token_scores_sql("""(SELECT DISTINCT req_description, description, r_tokens, q_tokens FROM pairs)""",
                                       "r_tokens", "q_tokens").replace(
    "SELECT * EXCLUDE (sim_s", "SELECT * EXCLUDE (r_tokens, q_tokens, sim_s")

CTES["full_statuses"] = """SELECT s.* EXCLUDE (eq_status), p.similarity, CASE WHEN s.eq_status <> 'PARCIAL' THEN s.eq_status
    WHEN p.similarity >= 85 THEN 'EQUIVALENTE COM REVISÃO' WHEN p.similarity >= 65 THEN 'REVISAR' ELSE 'DIVERGENTE' END AS eq_status
    FROM statuses s JOIN pair_scores p ON s.req_description = p.req_description AND s.description = p.description"""

CTES["statuses"] = """SELECT *, CASE WHEN is_zero THEN 'NÃO COTADO'
    WHEN qty_check <> 'OK' OR unit_check <> 'OK' THEN 'DIVERGÊNCIA ESTRUTURAL'
    WHEN attr_divergences > 0 THEN 'DIVERGÊNCIA'
    WHEN is_full THEN 'EQUIVALENTE' ELSE 'PARCIAL' END AS eq_status FROM pairs"""

CTES["cells"] = """SELECT *, eq_status <> 'NÃO COTADO' AND qty_check = 'OK' AND unit_check = 'OK'
    AND attr_divergences = 0 AND unit_price > 0 AS price_eligible,
    eq_status = 'EQUIVALENTE' AS eligible FROM statuses"""

CTES["offers"] = """SELECT c.*, payment_days, delivery_days, freight_included, freight_informed,
    min(CASE WHEN eligible THEN unit_price END) OVER w AS low,
    max(CASE WHEN eligible THEN payment_days END) OVER w AS longest,
    min(CASE WHEN eligible AND delivery_days > 0 THEN delivery_days END) OVER w AS fastest
    FROM cells c LEFT JOIN indicators t ON c.rfq_id = t.rfq_id AND c.supplier = t.supplier
    WINDOW w AS (PARTITION BY c.rfq_id, c.item_id)"""

CTES["part_scores"] = """SELECT *,
    CASE WHEN eligible THEN low / unit_price * 100 ELSE 0.0 END AS price_score,
    CASE WHEN eligible THEN 100.0 ELSE 0.0 END AS sim_score,
    CASE WHEN eligible THEN 100.0 ELSE 0.0 END AS attr_score,
    CASE WHEN eligible AND longest > 0 THEN payment_days / longest * 100 END AS payment_score,
    CASE WHEN NOT eligible OR fastest IS NULL THEN NULL WHEN delivery_days > 0 THEN fastest / delivery_days * 100
         WHEN delivery_days = 0 THEN 100.0 END AS delivery_score,
    CASE WHEN eligible AND freight_informed THEN CASE WHEN freight_included THEN 100.0 ELSE 0.0 END END AS freight_score
    FROM offers"""

CTES["commercial"] = """SELECT *, CASE WHEN NOT eligible THEN 0.0
    WHEN payment_score IS NULL AND delivery_score IS NULL AND freight_score IS NULL THEN 50.0
    ELSE (coalesce(payment_score, 0) + coalesce(delivery_score, 0) + coalesce(freight_score, 0))
       / (CASE WHEN payment_score IS NULL THEN 0 ELSE 1 END + CASE WHEN delivery_score IS NULL THEN 0 ELSE 1 END
          + CASE WHEN freight_score IS NULL THEN 0 ELSE 1 END) END AS commercial_score FROM part_scores"""

CTES["finals"] = """SELECT *, CASE WHEN eligible THEN least(100.0, greatest(0.0,
    price_score * 0.3 + sim_score * 0.2 + attr_score * 0.2 + commercial_score * 0.3)) ELSE 0.0 END AS final_score
    FROM commercial"""

CTES["ranked"] = """SELECT *, CASE WHEN NOT eligible THEN 'NÃO RECOMENDADO' WHEN final_score >= 90 THEN 'EXCELENTE'
    WHEN final_score >= 75 THEN 'BOA' WHEN final_score >= 60 THEN 'ACEITÁVEL' ELSE 'NÃO RECOMENDADO' END AS score_class,
    row_number() OVER (PARTITION BY rfq_id, item_id ORDER BY eligible DESC, final_score DESC,
        unit_price ASC, commercial_score DESC, supplier ASC) AS place,
    max(CASE WHEN eligible THEN final_score END) OVER (PARTITION BY rfq_id, item_id) AS best_score
    FROM finals"""

CTES["winners"] = """SELECT i.rfq_id, i.item_id, coalesce(r.supplier, 'NENHUM') AS winner,
    coalesce(r.final_score, 0.0) AS final_score, r.unit_price, r.quantity,
    coalesce(r.score_class, 'SEM OPÇÃO ELEGÍVEL') AS score_class, r.price_score, r.commercial_score
    FROM items i LEFT JOIN (SELECT * FROM ranked WHERE eligible AND place = 1) r
    ON i.rfq_id = r.rfq_id AND i.item_id = r.item_id"""

CTES["ties"] = """SELECT rfq_id, item_id, count(*) AS n, string_agg(supplier, ', ' ORDER BY place) AS names
    FROM ranked WHERE eligible AND best_score - final_score <= 0.5 GROUP BY rfq_id, item_id"""

CTES["sellers"] = "SELECT DISTINCT rfq_id, supplier FROM kept"

CTES["grid"] = """SELECT i.rfq_id, i.item_id, s.supplier, i.description AS req_description,
    i.quantity AS req_quantity, i.unit AS req_unit
    FROM items i JOIN sellers s ON i.rfq_id = s.rfq_id"""

CTES["lows"] = """SELECT rfq_id, item_id, min(unit_price) AS min_price, max(unit_price) AS max_price
    FROM cells WHERE price_eligible GROUP BY rfq_id, item_id"""

CTES["best"] = """SELECT c.rfq_id, c.item_id, c.supplier FROM cells c JOIN lows l
    ON c.rfq_id = l.rfq_id AND c.item_id = l.item_id
    WHERE price_eligible AND abs(unit_price - min_price) <= 1e-8 + 1e-5 * abs(min_price)"""

CTES["cmap"] = """SELECT i.rfq_id, i.item_id, i.description, i.quantity, i.unit, min_price, max_price,
    CASE WHEN min_price > 0 THEN (max_price - min_price) / min_price * 100 END AS spread_pct,
    coalesce(b.names, '') AS best_suppliers, coalesce(s.divergent, 0) AS divergent,
    v.n_suppliers - coalesce(s.quoted, 0) AS not_quoted
    FROM items i
    LEFT JOIN lows l ON i.rfq_id = l.rfq_id AND i.item_id = l.item_id
    LEFT JOIN (SELECT rfq_id, item_id, string_agg(supplier, ', ' ORDER BY supplier) AS names
               FROM best GROUP BY rfq_id, item_id) b ON i.rfq_id = b.rfq_id AND i.item_id = b.item_id
    LEFT JOIN (SELECT rfq_id, item_id, count(*) FILTER (WHERE eq_status <> 'NÃO COTADO') AS quoted,
                      count(*) FILTER (WHERE eq_status IN ('DIVERGÊNCIA', 'DIVERGÊNCIA ESTRUTURAL')) AS divergent
               FROM cells GROUP BY rfq_id, item_id) s ON i.rfq_id = s.rfq_id AND i.item_id = s.item_id
    LEFT JOIN (SELECT rfq_id, count(*) AS n_suppliers FROM sellers GROUP BY rfq_id) v ON i.rfq_id = v.rfq_id"""

CTES["summary"] = """SELECT s.rfq_id, s.supplier, count(c.item_id) FILTER (WHERE eq_status <> 'NÃO COTADO') AS quoted,
    max(n.n_items) - count(c.item_id) FILTER (WHERE eq_status <> 'NÃO COTADO') AS not_quoted,
    count(c.item_id) FILTER (WHERE eq_status = 'EQUIVALENTE') AS equivalent,
    count(c.item_id) FILTER (WHERE eq_status IN ('DIVERGÊNCIA', 'DIVERGÊNCIA ESTRUTURAL')) AS divergent,
    count(c.item_id) FILTER (WHERE price_eligible) AS eligible_prices,
    count(b.item_id) AS lowest_prices,
    CASE WHEN count(c.item_id) FILTER (WHERE eq_status <> 'NÃO COTADO') = 0 THEN 0.0
         ELSE count(b.item_id) * 100.0 / count(c.item_id) FILTER (WHERE eq_status <> 'NÃO COTADO') END AS lowest_pct,
    coalesce(sum(unit_price * quantity) FILTER (WHERE price_eligible), 0.0) AS eligible_total
    FROM sellers s
    LEFT JOIN cells c ON s.rfq_id = c.rfq_id AND s.supplier = c.supplier
    LEFT JOIN best b ON c.rfq_id = b.rfq_id AND c.item_id = b.item_id AND c.supplier = b.supplier
    LEFT JOIN (SELECT rfq_id, count(*) AS n_items FROM items GROUP BY rfq_id) n ON s.rfq_id = n.rfq_id
    GROUP BY s.rfq_id, s.supplier"""

CTES["figures"] = """SELECT m.*, leader, leader_lowest_prices, suppliers FROM (
    SELECT rfq_id, count(*) AS items, count(min_price) AS items_with_price,
        count(*) - count(min_price) AS items_without_price,
        count(*) FILTER (WHERE divergent > 0) AS items_divergent,
        count(*) FILTER (WHERE not_quoted > 0) AS items_not_quoted,
        max(spread_pct) AS max_spread_pct FROM cmap GROUP BY rfq_id) m
    LEFT JOIN (SELECT rfq_id, supplier AS leader, lowest_prices AS leader_lowest_prices,
        row_number() OVER (PARTITION BY rfq_id ORDER BY lowest_prices DESC, supplier) AS n,
        count(*) OVER (PARTITION BY rfq_id) AS suppliers FROM summary) s
    ON m.rfq_id = s.rfq_id AND s.n = 1"""
