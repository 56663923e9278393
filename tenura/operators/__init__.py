"""Operators: each takes DataFrames and returns DataFrames (or a fitted model made of small arrays)."""
