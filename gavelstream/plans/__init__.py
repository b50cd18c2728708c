"""The query catalogue and its oracle."""
