"""Queries over the tables, one for each operator."""

from ratemill.plans import boards, core, details, extraction, landed, probes, relational, rules, scores, streams, surveys, text
from ratemill.plans.registry import ORACLES, QUERIES, Query

__all__ = ["all_oracles", "all_queries", "boards", "core", "details", "extraction", "landed", "probes", "relational", "rules", "scores", "streams", "surveys", "text"]


def all_queries() -> dict[str, Query]:
    return QUERIES


def all_oracles() -> dict[str, str]:
    return ORACLES
