"""The queries as Structured Streaming jobs."""
