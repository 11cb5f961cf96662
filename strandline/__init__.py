"""A PySpark library for cross-sectional backtests, their validation, and corpus preparation."""
