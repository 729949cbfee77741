"""Text cleaning as native column expressions."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

# White space as Python's str.strip understands it: a character list and its class.
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE = f"[{SPACE_CHARS}]"

# Whole-word unit spellings and the word they stand for.
UNIT_WORDS = (
    ("unid|un", "unidade"),
    ("pcs|pc", "peca"),
    ("caixas|caix", "caixa"),
    ("pcts|pct", "pacote"),
)

# Recognised colours and tips, in order of precedence.
COLOURS = ("azul", "preto", "branco", "vermelho", "verde", "amarelo", "rosa", "cinza")
TIPS = ("fina", "media", "grossa")


def _fold_tables():
    """One-to-one, to-nothing and one-to-many compatibility foldings of the BMP.

    Hangul syllables and CJK compatibility ideographs are left out: no later step
    keeps or compares their decomposed form.
    """
    single, dropped, many = {}, [], {}
    for code in range(0xA0, 0x10000):
        if 0xAC00 <= code <= 0xD7FF or 0xD800 <= code <= 0xF8FF or 0xF900 <= code <= 0xFAFF:
            continue
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char)
                         if not unicodedata.combining(c))
        if folded == char:
            continue
        if not folded:
            dropped.append(char)
        elif len(folded) == 1:
            single[char] = folded
        else:
            many[char] = folded
    return single, dropped, many


_SINGLE, _DROPPED, _MANY = _fold_tables()
# translate() deletes the characters beyond the end of the replacement string.
_FOLD_FROM = "".join(_SINGLE) + "".join(_DROPPED)
_FOLD_TO = "".join(_SINGLE.values())
_MANY_TABLE = "\x01".join(f"{k}\x02{v}" for k, v in _MANY.items())


def _class_of(chars) -> str:
    """A character class of ``chars`` as a tree of nested ranges: a text's characters are not tried against every member."""
    codes, ranges = sorted(map(ord, chars)), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])

    def tree(part) -> str:
        plain = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in part)
        if len(part) <= 3:
            return f"[{plain}]"
        half = len(part) // 2
        return f"[\\x{{{part[0][0]:x}}}-\\x{{{part[-1][1]:x}}}&&[{tree(part[:half])}{tree(part[half:])}]]"

    return tree(ranges)


_MANY_CLASS = _class_of(_MANY)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    """Single spaces; texts of plain single-spaced ASCII skip the wide pattern."""
    unusual = c.contains("  ") | c.rlike(r"[^\x20-\x7e]")
    return strip(F.when(unusual, F.regexp_replace(c, f"{SPACE}+", " ")).otherwise(c))


def clean_text(c: Column) -> Column:
    """Trimmed text; empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def clean_unit(c: Column) -> Column:
    return F.nullif(F.upper(strip(c)), F.lit(""))


def stable_key(c: Column) -> Column:
    """Case- and space-insensitive identity of a name; null counts as empty."""
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without the combining marks."""
    table = F.str_to_map(F.lit(_MANY_TABLE), F.lit("\x01"), F.lit("\x02"))
    expanded = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")
    wide = F.when(c.rlike(_MANY_CLASS), expanded).otherwise(c)
    return F.when(is_ascii(c), c).otherwise(F.translate(wide, _FOLD_FROM, _FOLD_TO))


def _lowered(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _expand_units(c: Column) -> Column:
    out = c
    for spellings, word in UNIT_WORDS:
        out = F.regexp_replace(out, rf"(?U)\b(?:{spellings})\b", word)
    # The literal searches are far cheaper than the word patterns and rule most texts out.
    return F.when(c.contains("un") | c.contains("pc") | c.contains("caix"), out).otherwise(c)


def _keep_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^a-z0-9.]+", " "))


def normalize_text(c: Column) -> Column:
    """Comparable form of a description or unit: ``[a-z0-9.]`` words, single spaces.

    The dot survives so that 1.5 and 15 stay different.
    """
    return _keep_words(_expand_units(fold_accents(_lowered(c))))


def add_normalized(df: DataFrame, source: str, name: str) -> DataFrame:
    """``normalize_text`` as a column, in steps so that no step is evaluated twice."""
    return (df.withColumn(name, _lowered(F.col(source)))
            .withColumn(name, fold_accents(F.col(name)))
            .withColumn(name, _keep_words(_expand_units(F.col(name)))))


def normalize_header(c: Column) -> Column:
    text = fold_accents(_lowered(c))
    text = F.replace(text, F.lit("&"), F.lit(" e "))
    text = F.regexp_replace(text, r"[_\-/\\|:;]+", " ")
    text = F.regexp_replace(text, rf"(?U)[^\w.%]+", " ")
    return F.trim(text)


def tokens(normalized: Column) -> Column:
    """Distinct words of a normalized text; empty text has none."""
    return F.array_remove(F.array_distinct(F.split(normalized, " ")), "")


def _first_listed(normalized: Column, words) -> Column:
    listed = F.array(*[F.lit(w) for w in words])
    found = F.array_intersect(listed, F.split(F.translate(normalized, ".", " "), " "))
    return F.when(normalized.rlike("|".join(words)), F.get(found, F.lit(0)))


def extract_attributes(normalized: Column) -> Column:
    """Struct of colour, tip, size and grammage read from a normalized text."""
    number = r"\b(\d+(?:[.,]\d+)?)\s*"
    size = F.nullif(F.regexp_extract(normalized, number + r"(?:cm|mm|m)\b", 0), F.lit(""))
    grams = F.nullif(F.regexp_extract(normalized, number + r"g\b", 1), F.lit(""))
    return F.struct(
        _first_listed(normalized, COLOURS).alias("colour"),
        _first_listed(normalized, TIPS).alias("tip"),
        F.concat(F.btrim(size, F.lit(" cm")), F.lit(" "),
                 F.btrim(size, F.lit("0123456789., "))).alias("size"),
        F.concat(grams, F.lit(" g")).alias("grammage"),
    )
