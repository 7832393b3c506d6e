"""All named queries. Importing this module registers them."""

from __future__ import annotations

from corpusloom.plans import q_aggregates, q_chat, q_code, q_dedup, q_filters, q_generated, q_joins, q_more, q_recipes, q_rules, q_sampling, q_sources, q_streams, q_text, q_tokens  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL

FLAGSHIP = QUERIES["build_reason_ladder"]
