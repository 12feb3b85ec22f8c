"""Compositions of operators: materialisation helpers, evaluation and the workflow."""
