"""Operators over documents: DataFrame to DataFrame, or Column to Column."""
