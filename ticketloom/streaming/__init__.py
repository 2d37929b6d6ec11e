"""The batch flows under Structured Streaming."""
