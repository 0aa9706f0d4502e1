"""Query functions and their SQL, side by side, by theme.

Each module fills a Catalogue; `queries` and `oracle_sql` put them together.
"""

from __future__ import annotations


def _all():
    from . import activity, aggregates, collation, files, geo, geometry, graph, merges, more, scalars, search, spans, streams, text, wikitext

    return [m.catalogue for m in (graph, aggregates, merges, activity, geo, scalars, text, wikitext, more, files, search, streams, geometry, collation, spans)]


def queries() -> dict:
    return {k: f for c in _all() for k, f in c.functions.items()}


def oracle_sql() -> dict:
    return {k: s for c in _all() for k, s in c.sql.items()}
