"""Operators of a training-data pipeline over tables of documents.

Each module holds one operator with its own interface; ``queries`` wraps them
for the driver tables.  Nothing outside this folder imports it.
"""
