"""Drift analysis of keyed embedding tables as Spark plans."""
