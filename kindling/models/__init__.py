"""Spark ML regressors, tuning, importances and scoring."""
