"""Whole pipelines: from tables to evaluated matches."""
