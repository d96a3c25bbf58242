"""Operators of a training-data pipeline: dedup, decontamination, scoring, mixing, archives, URL rules."""
