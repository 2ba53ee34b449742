"""All registered queries (import side effect fills the registry)."""

from __future__ import annotations

from scholarq.plans import q_boundaries, q_cluster, q_delta, q_mentions, q_merge, q_metadata, q_pages, q_search, q_sources, q_tagging, q_text, q_unified  # noqa: F401
from scholarq.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
