"""Checks over arriving contents with Structured Streaming."""
