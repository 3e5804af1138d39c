"""The registered queries of the library itself."""

from __future__ import annotations

from . import catalogue, flows, graphs, round_trips, smoothing  # noqa: F401

QUERIES = catalogue.QUERIES
ORACLES = catalogue.ORACLES
FLAGSHIP = catalogue.select_samples
