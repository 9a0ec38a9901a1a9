"""Scalar functions: Column algebra where Spark has it, NumPy where it hasn't."""
