"""Modules that hold QUERIES and ORACLES."""

from __future__ import annotations


def modules() -> list:
    from tidelot.plans import monitoring, reads, stream_core, streams

    return [streams, stream_core, reads, monitoring]
