"""Running one program over a DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import _built, compile_program
from ..plans.program import Program, parse

ON_ERROR = ("raise", "null", "report")


def transform(df: DataFrame, program: Program | str | dict[str, Any], on_error: str = "raise", keep: list[str] | None = None) -> DataFrame:
    """The program's target, one column for each of its top-level names, as a
    single projection.  ``keep``: columns of ``df`` to carry along in front.

    on_error: ``raise`` fails the query at a bad row, ``null`` makes its target
    columns null, ``report`` does so too and adds a column ``error``.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}")
    made = compile_program(program if isinstance(program, Program) else parse(program), df.schema)
    error = made.error()
    columns = []
    for name, node in made.tree.items():
        col = _built(node).col
        if made.errors:
            failed = F.raise_error(error) if on_error == "raise" else F.lit(None)
            col = F.when(error.isNull(), col).otherwise(failed)
        columns.append(col.alias(name))
    if on_error == "report":
        columns.append(error.alias("error"))
    return df.select(*(F.col(c) for c in keep or []), *columns)
