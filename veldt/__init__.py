"""A strictly typed relational engine on PySpark."""

__version__ = "0.1.0"
