"""Sync-loss analytics on Spark DataFrames."""
