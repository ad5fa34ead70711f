"""Operators of a training-data pipeline: deduplication, decontamination, scrubbing, tokens."""
