"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from echofield.plans import (  # noqa: F401
    bandit,
    calibration,
    exposure,
    graph,
    metrics,
    quality,
    sampling,
    sources,
    state,
    stats,
    streams,
)
from echofield.plans.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
