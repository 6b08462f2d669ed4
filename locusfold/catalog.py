"""The registered queries of the library's own operators and their SQL counterparts."""

from __future__ import annotations

from .plans import attribution, core, evaluation, genome, importance, models  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
