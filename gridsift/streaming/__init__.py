"""File streams and event-time operators on Structured Streaming."""
