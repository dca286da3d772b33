"""All queries of the library: importing the modules registers them."""

from quarryline.plans import answers, calls, contexts, limits, operational, policies, retrieval, texts, transactions, uploads  # noqa: F401
from quarryline.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
