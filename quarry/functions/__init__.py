"""Scalar functions: native Column expressions, and the pure-Python tree and JSON kernels behind the UDFs."""
