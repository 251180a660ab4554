"""Operators: DataFrame in, DataFrame out, for all fires at once."""
