"""Landed feeds to typed rows, and the sinks."""
