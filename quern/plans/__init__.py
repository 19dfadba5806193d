"""Logical operations and plans as Python objects that run as DataFrames."""
