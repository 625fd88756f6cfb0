"""Readers of the landing files, their normalisers, and the sinks."""
