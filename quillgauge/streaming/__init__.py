"""Structured Streaming: the gate over arriving pairs, and windowed counts."""
