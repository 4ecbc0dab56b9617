"""All registered queries of the reference's own operators and their SQL."""

from . import answer_queries, block_queries, catalogue_queries, ingest_queries, layout_queries, retrieval_queries, source_queries, state_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "answer_queries", "block_queries", "catalogue_queries", "ingest_queries", "layout_queries", "retrieval_queries", "source_queries", "state_queries", "text_queries"]
