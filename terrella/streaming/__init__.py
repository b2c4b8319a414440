"""The same expressions under Structured Streaming."""
