"""Query results as tab-separated text: a header, a line a row, NULL for an unbound variable.

Backslash, tab, newline and carriage return inside a value are written as \\\\, \\t, \\n and \\r, so that a row stays a line.
"""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(name: str) -> Column:
    text = F.col(f"`{name}`").cast("string")
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit("NULL"))


def lines(df: DataFrame) -> DataFrame:
    """A line a row, without the header."""
    return df.select(F.concat_ws("\t", *[_cell(c) for c in df.columns]).alias("value"))


def show(df: DataFrame, out: TextIO | None = None) -> None:
    """Print df; the driver holds one partition at a time."""
    out = out or sys.stdout
    print(*df.columns, sep="\t", file=out)
    for row in lines(df).toLocalIterator():
        print(row.value, file=out)


def write(df: DataFrame, path: str) -> None:
    """Write df as text files with a header each, by the executors."""
    cells = df.select(*[_cell(c).alias(c) for c in df.columns])
    cells.write.mode("overwrite").options(sep="\t", header=True, quote="\0", escape="\0", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
