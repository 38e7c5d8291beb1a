"""Agent-interaction analytics on Spark."""
