"""Streaming and batch analytics over an online auction, on PySpark."""
