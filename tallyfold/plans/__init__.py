"""Chains of operators: the weekly curation, a search, a discovery run."""
