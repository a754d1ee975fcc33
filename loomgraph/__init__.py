"""Property-graph analytics over source code and event logs, expressed as Spark plans."""
