"""Lodestone: code archives as tables, and the questions one asks of them, on Spark."""
