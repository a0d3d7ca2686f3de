"""Structured Streaming forms of scoring, trends and quality counters."""
