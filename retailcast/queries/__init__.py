"""Every operator as a query over the test tables, with the SQL that checks it."""

from retailcast.queries import (  # noqa: F401  (importing fills the registry)
    accuracy,
    backtests,
    business,
    checking,
    cleaning,
    describing,
    modelling,
    profiling,
    series,
)
from retailcast.queries.registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
