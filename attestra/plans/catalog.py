"""Importing this module fills the registry."""

from attestra.plans import temporal  # noqa: F401, I001
from attestra.plans import cases, evidence, figures, freshness, functions, gates, graphs, io, monitoring, overview, pages, published, streams, succession  # noqa: F401
from attestra.plans.registry import ORACLES, QUERIES  # noqa: F401
