"""Event-time occupancy analytics over sensor streams, as DataFrame plans."""
