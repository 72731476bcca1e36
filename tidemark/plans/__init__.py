"""The marts: DataFrame in, DataFrame out."""
