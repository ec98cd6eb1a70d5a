"""Hearthline: listing analytics and training-data operators on Spark."""
