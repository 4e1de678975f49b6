"""Small helpers for expressions written as SQL text.

Long expressions are kept as text: one call builds them, where chaining column
objects takes a driver round trip per node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def q_list(items) -> str:
    return ", ".join(q(i) for i in items)


def let(value: str, var: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value`` once."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def bind(value: Column, var: str, body: str) -> Column:
    """The same for a column value."""
    fn = F.expr(f"{var} -> {body}")
    return F.call_function("element_at", F.call_function("transform", F.array(value), fn), F.lit(1))
