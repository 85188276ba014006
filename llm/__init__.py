"""Operators of a training-data pipeline over tables of documents. Nothing outside this package imports it."""
