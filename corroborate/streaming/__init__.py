"""Structured Streaming forms of the evidence pipeline."""
