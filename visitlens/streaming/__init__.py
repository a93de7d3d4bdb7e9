"""The same duties as Structured Streaming jobs."""
