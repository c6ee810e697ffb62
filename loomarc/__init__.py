"""loomarc: a PySpark-native engine for long conversation archives.

Every operator is a pure function from DataFrame to DataFrame; plans stay lazy until a
sink or a query result is read.
"""

__version__ = "0.1.0"
