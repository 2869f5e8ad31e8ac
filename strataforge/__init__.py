"""strataforge: a Spark-first engine for versioned feature datasets.

Plans are declared with the DataFrame and SQL API; Arrow functions appear
only where linear algebra or a sequential rule needs them.
"""

__version__ = "0.1.0"
