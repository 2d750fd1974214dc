"""Live capture: following journals with Structured Streaming."""
