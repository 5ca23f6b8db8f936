"""Structured Streaming. The benchmark this follows has none; these are extensions."""
