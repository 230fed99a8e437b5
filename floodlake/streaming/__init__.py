"""Incremental intake of scenes and job states with Structured Streaming."""
