"""The incremental operators hosted in Structured Streaming."""
