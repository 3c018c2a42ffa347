"""Operators over the message table: each takes and returns DataFrames."""
