"""Number parsing and checks."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def is_positive(c: Column) -> Column:
    """Finite and greater than zero; null counts as no."""
    return F.coalesce(finite(c) > 0, F.lit(False))


def parse_locale_number(c: Column) -> Column:
    """Number from text in ``1.234,56`` or ``1,234.56`` style, with any currency sign.

    With both separators the last one is the decimal; a lone comma is decimal; of
    several dots the last is decimal. Text that is no number gives null.
    """
    return _once(_once(F.regexp_replace(c, r"[^0-9,.\-]", ""), _number), finite)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where Spark would do it again for each mention: in filters and aggregates."""
    return F.transform(F.array(value), use)[0]


def _number(kept: Column) -> Column:
    after_comma = F.substring_index(kept, ",", -1)
    no_dots = F.replace(kept, F.lit("."), F.lit(""))
    comma_decimal = F.replace(no_dots, F.lit(","), F.lit("."))
    comma_group = F.replace(kept, F.lit(","), F.lit(""))
    has_comma, has_dot = kept.contains(","), kept.contains(".")
    last_is_comma = ~after_comma.contains(".")
    dotted = F.when(
        F.length(kept) - F.length(no_dots) > 1,
        F.regexp_replace(kept, r"\.(?=.*\.)", "")).otherwise(kept)
    text = (F.when(has_comma & (~has_dot | last_is_comma), comma_decimal)
            .when(has_comma, comma_group)
            .otherwise(dotted))
    return text.try_cast("double")


def variation_pct(low: Column, high: Column) -> Column:
    """Spread of two prices in percent of the lower; null without a positive base."""
    return F.when(low > 0, F.round((high - low) / low * 100, 2))


def is_close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """Symmetric closeness: within ``rel`` of the larger magnitude, or ``absolute``."""
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(absolute))
