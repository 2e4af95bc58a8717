"""All queries: ``{key: (callable, SQL twin or None)}``."""

from __future__ import annotations

from riskframe.plans import encoding, explaining, fairness, flows, inference, learning, measuring, preparing

MODULES = (preparing, encoding, measuring, fairness, inference, learning, explaining, flows)


def catalog() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found
