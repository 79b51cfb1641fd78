"""Operators: functions from DataFrames to DataFrames. Nothing here runs a job unless its docstring says so."""
