"""Operators over unified events: each takes DataFrames and returns one."""
