"""Compositions of operators: registered queries and whole pipelines."""
