"""Every query of the session engine by key, with its SQL counterpart."""

from __future__ import annotations

from . import blobs, diagnosis, formats, graphs, projection, registry, searches, sessions, stats, timeline, usage

_PARTS = (stats, usage, sessions, timeline, searches, graphs, diagnosis, projection, registry, formats, blobs)

QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLES.items()}
