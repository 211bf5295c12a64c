"""tailrace: a Spark-native engine for a corpus of incident reports.

Operators are functions from DataFrames to DataFrames; the scalar functions
are ``Column`` builders, so that batch queries and streams share them.
"""

__version__ = "0.1.0"
