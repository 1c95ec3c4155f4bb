"""All registered queries over the supplied tables."""

from traitloom.plans import ledger_queries, record_queries, store_queries, table_queries, text_queries, trait_queries  # noqa: F401
from traitloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
