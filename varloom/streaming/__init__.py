"""Streaming form of the daily realised variance."""
