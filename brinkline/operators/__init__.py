"""Operators: regressions, threshold search, resampling, forests, summaries."""
