"""roadlens: urban-traffic analytics as Spark DataFrame operators.

Every operator is a plain function ``(DataFrame, ..., params) -> DataFrame``
built from Spark SQL expressions, windows and joins.
"""

__version__ = "0.1.0"
