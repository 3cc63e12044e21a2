"""schema of the engine."""
