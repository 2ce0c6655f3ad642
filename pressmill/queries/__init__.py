"""The operators bound to the standard tables, with reference SQL where SQL can say it."""

from pressmill.queries import base


def load() -> None:
    from pressmill.queries import (  # noqa: F401
        digest_queries,
        document_queries,
        link_queries,
        page_queries,
        report_queries,
        review_queries,
        score_queries,
        table_queries,
        text_queries,
    )


load()

QUERIES = base.QUERIES
ORACLES = base.ORACLES
