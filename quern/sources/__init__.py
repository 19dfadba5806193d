"""Snapshots and change logs on any file system that Spark reads."""
