"""strataline: log-structured runs, learned indexes and trace analytics on PySpark."""

__version__ = "0.1.0"
