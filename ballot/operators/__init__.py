"""Operators O05-O41: DataFrame in, DataFrame out."""
