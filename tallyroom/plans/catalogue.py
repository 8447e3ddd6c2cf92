"""Every registered query, and its SQL."""

from __future__ import annotations

from tallyroom.plans import blocks, career, dictionaries, events, filters, graphs, intervals, language, learning, matching, offers, profiles, ranking, records, registry, resumes, scoring, streams, texts  # noqa: F401

FLAGSHIP = "lexeme_log_odds"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
