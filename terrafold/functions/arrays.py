"""Vectors and matrices as arrays of doubles, in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    """Element by element."""
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(times(a, b), F.lit(0.0), lambda s, x: s + x)


def column(m: Column, j: int | Column) -> Column:
    """Column ``j`` of a matrix of rows."""
    return F.transform(m, lambda r: F.get(r, j if isinstance(j, Column) else F.lit(j)))


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def multiply(a: Column, b: Column) -> Column:
    """Matrix product; null if the sizes do not fit."""
    product = F.transform(a, lambda r: F.transform(transpose(b), lambda c: dot(r, c)))
    return F.when(F.size(F.get(a, F.lit(0))) == F.size(b), product)


def subset(m: Column, rows: Column, columns: Column) -> Column:
    """Rows and columns of a matrix by index."""
    return F.transform(rows, lambda i: F.transform(columns, lambda j: F.get(F.get(m, i), j)))


def integers(start: Column, end: Column, include_end: bool = False) -> Column:
    """Whole numbers from ``start`` to ``end``; empty if there are none."""
    last = end if include_end else end - 1
    return F.when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))


def along(m: Column, rows: bool, f) -> Column:
    """f of each row, or of each column."""
    return F.transform(m if rows else transpose(m), f)


def stacked(a: Column, b: Column, rows: bool) -> Column:
    """Matrices below or beside each other."""
    return F.concat(a, b) if rows else F.zip_with(a, b, lambda x, y: F.concat(x, y))
