"""Pieces of SQL text."""

from __future__ import annotations


def rnd(x: str, digits: int) -> str:
    """Rounded double; adding zero turns -0 into 0."""
    return f"(ROUND(CAST({x} AS DOUBLE), {digits}) + 0e0)"


def with_tables(tables: dict[str, str], body: str) -> str:
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in tables.items())
    return f"WITH {parts}\n{body}"


def rnd_decimal(x: str, digits: int) -> str:
    """Rounded by decimal text, half away from zero, where exact ties of decimals can occur.

    DuckDB rounds the binary value, so that 77.195 may become 77.19; Spark rounds the number as
    it is printed.
    """
    text = f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18))"
    return f"(CAST(ROUND({text}, {digits}) AS DOUBLE) + 0e0)"
