"""All registered queries."""

from strandwise.plans import q_concordance, q_intervals, q_ranking, q_score_table, q_scoring, q_sources, q_starts, q_tracks, q_transcripts  # noqa: F401
from strandwise.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
