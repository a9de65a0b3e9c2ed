"""Compositions of operators: the pipeline, the registered queries and their SQL oracles."""
