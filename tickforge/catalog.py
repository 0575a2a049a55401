"""All registered queries with their oracle SQL."""

from tickforge.plans import backtests, cycles, features, incremental, market, older, scores  # noqa: F401
from tickforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
