"""All registered queries with their expanded checking SQL."""
from bidframe.plans import checks, quote_queries, report_queries, sheet_queries  # noqa: F401  (registration)
from bidframe.plans.registry import ORACLES, QUERIES, expand


def oracles() -> dict[str, str]:
    return {name: expand(sql) for name, sql in ORACLES.items()}


__all__ = ["QUERIES", "oracles"]
