"""Operators: functions from DataFrames and arguments to a DataFrame."""
