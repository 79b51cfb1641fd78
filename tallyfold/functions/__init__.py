"""Column functions: built-in expressions only, so that everything stays inside generated code."""
