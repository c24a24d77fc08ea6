"""Readers and writers for triggers, sample chunks, models and submissions."""
