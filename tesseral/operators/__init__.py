"""Relational operators: DataFrame in, DataFrame out, columns as parameters."""
