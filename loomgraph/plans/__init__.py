"""Query plans: the fixture view, the query registry and the engine."""
