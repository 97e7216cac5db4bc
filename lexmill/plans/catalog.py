"""All registered queries."""

from . import (  # noqa: F401
    block_queries, chunk_queries, citation_queries, corpus_queries, index_queries, report_queries,
    search_queries, stream_queries, text_queries, flow_queries, reader_queries,
)
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
