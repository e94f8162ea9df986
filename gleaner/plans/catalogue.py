"""Every query of the engine's own operators."""

from gleaner.plans import labels, links, retrieval, site, storage
from gleaner.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "labels", "links", "retrieval", "site", "storage"]
