"""Grain-aware analytics on Spark: every dataset is a lazy DataFrame with the keys that identify a row."""
