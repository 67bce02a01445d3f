"""All registered queries."""

from tidewire.plans import queries_flows, queries_models, queries_tables  # noqa: F401  (they register on import)
from tidewire.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
