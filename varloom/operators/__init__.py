"""Operators over panels keyed by asset and date."""
