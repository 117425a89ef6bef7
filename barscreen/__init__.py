"""Daily-bar analytics on Spark: adjustment, indicators, screening, backtests and reports."""
