"""The query registry and the oracle SQL beside it."""
