"""Whole jobs built from the operators: reports, backtests, the daily run."""
