"""A PySpark engine for finding repetition worth acting on, in source code and in any table of ordered lines or tokens."""

__version__ = "0.1.0"
