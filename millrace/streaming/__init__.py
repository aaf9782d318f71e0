"""The event operators on Structured Streaming."""
