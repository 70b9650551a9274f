"""The registered queries, each with the operators it covers and its SQL counterpart."""

from __future__ import annotations

from hourlake.queries import aggregates, bases, exports, gaps, payloads, quality, refreshed, series, states, stored, streams, tops, windows  # noqa: F401
from hourlake.queries.registry import COVERS, ORACLES, QUERIES  # noqa: F401
