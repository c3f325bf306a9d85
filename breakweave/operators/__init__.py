"""Operators over interval and evidence DataFrames."""
