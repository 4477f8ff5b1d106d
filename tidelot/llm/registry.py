"""Queries of this package by name, with their SQL."""

from __future__ import annotations

from types import SimpleNamespace

from tidelot.llm import queries as q
from tidelot.llm.sql import ORACLES

_NAMES = ("p2_distinct_tokens", "p2_bounds_hold", "p2_beside_windows", "p7_found", "p7_near_runs", "p7_near_cost", "p8_ids", "p8_round_trip", "p8_offsets", "p9_mix_selection", "p9_mix_shares", "p9_rules_kept", "p9_whole_budget", "p10_found", "p10_by_source", "p10_by_evidence")


def modules() -> list:
    return [SimpleNamespace(QUERIES={n: getattr(q, n) for n in _NAMES}, ORACLES=ORACLES)]
