"""Small expression helpers shared by the operators.

The operators write most of their expressions as Spark SQL text: one call per
column instead of one per function, which keeps the time to build a plan of 16
passes low.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    if "'" in pattern:
        raise ValueError("patterns must not hold a single quote")
    return f"r'{pattern}'"


def quoted(column: str) -> str:
    """A column name as SQL text; names may hold dots and blanks."""
    return "`" + column.replace("`", "``") + "`"


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` once and use it many times in ``body``.

    A column that is referenced n times is an expression evaluated n times; a
    lambda variable is not.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def trim_blanks(text: Column) -> Column:
    """Trim blanks of any script, line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _running_spans() -> str:
    # Ends are running totals of the steps. They are summed in blocks, so the
    # work grows with n * 64 instead of n * n.
    size = 64
    block = f"slice(__state.found, b * {size} + 1, {size})"
    blocks = f"sequence(0, cast((size(__state.found) - 1) / {size} as int))"
    totals = f"transform({blocks}, b -> aggregate({block}, 0, (acc, r) -> acc + r.step))"
    bases = "transform(totals, (x, b) -> aggregate(slice(totals, 1, b), 0, (acc, y) -> acc + y))"
    end = "get(bases, b) + aggregate(slice(part, 1, i + 1), 0, (acc, q) -> acc + q.step)"
    record = let("stop", end, (
        f"named_struct('seq', b * {size} + i, 'pass', r.pass, 'entity', r.entity, "
        "'start', stop - r.size, 'end', stop)"
    ))
    of_block = let("part", block, f"transform(part, (r, i) -> {record})")
    return let("totals", totals, let(
        "bases", bases, f"flatten(transform({blocks}, b -> {of_block}))"
    ))


# The records of a row with their half-open byte range in the text of their pass.
SPANS = _running_spans()
