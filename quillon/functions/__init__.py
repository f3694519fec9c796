"""Column helpers: DataFrame expressions without Python UDFs."""
