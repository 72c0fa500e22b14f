"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column


def fixed(c: Column, decimals: int) -> Column:
    """Text with a fixed number of decimals, halves rounded up. A decimal cast stays in
    generated code, unlike ``format_string``."""
    return c.cast(f"decimal(30,{decimals})").cast("string")
