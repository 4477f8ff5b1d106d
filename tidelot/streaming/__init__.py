"""Structured Streaming: the keyed occupancy processor and sinks that may replay a batch."""
