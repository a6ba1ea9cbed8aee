"""Structured Streaming: trailing totals that stay current as readings arrive."""
