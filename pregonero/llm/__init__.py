"""Operators of a training-data pipeline: cleaning, deduplication, decontamination, scoring, scanning, formatting, mixing."""
