"""Streaming forms of the call, segment, meter and daily operators."""
