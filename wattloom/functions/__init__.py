"""Column-level building blocks: text, time, geometry and aggregation rules."""
