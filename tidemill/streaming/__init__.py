"""The same transformations over Structured Streaming."""
