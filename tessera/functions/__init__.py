"""Scalar functions: Catalyst column expressions, and pure-Python kernels shared with tests."""
