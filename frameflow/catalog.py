"""All queries of the engine and their SQL."""

from __future__ import annotations

from frameflow.plans import game, ground, motion, parts, people, scores, stores, streams, sweeps
from frameflow.plans.registry import ORACLES, QUERIES, Query

PLANS = (game, people, ground, scores, parts, stores, sweeps, streams, motion)
FLAGSHIP = "possession_share"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
