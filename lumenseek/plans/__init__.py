"""End-to-end plans: the engine and the query catalogue."""
