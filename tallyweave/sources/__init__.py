"""Readers of source bundles, and sinks."""
