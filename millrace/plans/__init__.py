"""The flow language: text to a plan, a plan to DataFrames and back to text."""
