"""Structured Streaming jobs that keep the marts fresh."""
