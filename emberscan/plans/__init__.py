"""Whole pipelines, and the query catalogue with its SQL counterparts."""
