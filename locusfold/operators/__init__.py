"""Operators: functions from DataFrames to DataFrames, and column functions."""
