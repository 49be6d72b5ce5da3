"""Named queries over the given tables, with the SQL that checks them where SQL can.

Every entry is ``name: (spark_query, sql_or_none)``.
"""

from __future__ import annotations

from quire.plans.catalog import (
    citation_queries,
    compliance_queries,
    edit_queries,
    formatting_queries,
    latex_queries,
    structure_queries,
    text_queries,
)

QUERIES = {
    **text_queries.QUERIES,
    **structure_queries.QUERIES,
    **citation_queries.QUERIES,
    **formatting_queries.QUERIES,
    **compliance_queries.QUERIES,
    **latex_queries.QUERIES,
    **edit_queries.QUERIES,
}
