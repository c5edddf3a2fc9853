"""Normalize and classify large tables or streams of short user posts on Spark."""
