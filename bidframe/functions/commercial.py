"""Free-text commercial terms."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from bidframe.functions.text import strip

# Words read in payment, delivery, freight and minimum-order texts.
IMMEDIATE = ("imediato", "imediata", "à vista", "a vista", "avista")
FREIGHT_NEGATED = ("não", "nao", "fob", "cliente", "comprador")
FREIGHT_INCLUDED = ("inclus", "cif", "fornecedor")
NO_MINIMUM = ("sem mínimo", "sem minimo", "não há", "nao ha",
              "não se aplica", "nao se aplica", "nenhum", "isento")
ZERO_MINIMUM = ("0", "0,00", "0.00")


def _lowered(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _mentions(text: Column, words) -> Column:
    return text.rlike("|".join(words))


def extract_days(c: Column) -> Column:
    """Days named in a text: 0 for immediate, else the first number, else null."""
    text = F.lower(strip(c))
    found = F.regexp_extract(text, r"(?U)(\d+(?:[.,]\d+)?)\s*(?:dias?|d)?\b", 1)
    return F.when(_mentions(text, IMMEDIATE), F.lit(0.0)).otherwise(
        F.replace(found, F.lit(","), F.lit(".")).try_cast("double"))


def freight_informed(c: Column) -> Column:
    return _lowered(c) != ""


def freight_included(c: Column) -> Column:
    text = _lowered(c)
    return _mentions(text, FREIGHT_INCLUDED) & ~_mentions(text, FREIGHT_NEGATED)


def no_min_order(c: Column) -> Column:
    """True unless a minimum is really demanded; silence demands none."""
    text = _lowered(c)
    return (text == "") | _mentions(text, NO_MINIMUM) | text.isin(*ZERO_MINIMUM)
