"""Tidemark: two-part differential analysis of sparse observation x feature tables on PySpark."""

__version__ = "0.1.0"
