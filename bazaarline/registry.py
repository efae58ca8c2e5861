"""All queries of the library, by operator id."""

from __future__ import annotations

from .plans import aggregates, base, details, domain, flagship, joins, market, merges, ordering, predicates, scalars, scans, streams, windows  # noqa: F401  each family registers itself

QUERIES, ORACLES = base.QUERIES, base.ORACLES
