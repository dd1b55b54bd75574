"""The load, the marts, the analytic statements and the quality checks."""
