"""scholarq: scholarly-paper analytics as Spark DataFrame operators.

Every public operator is a function from DataFrames (plus plain Python
parameters) to a DataFrame.  Nothing is collected inside an operator
except inputs with a proven small bound (a vocabulary capped by a
parameter, a one-row aggregate, a fixed lexicon).
"""

__all__ = ["session"]
