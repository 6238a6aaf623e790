"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, base: str, prefix: str = "__") -> str:
    """A name that no column of df has."""
    taken, name = {c.lower() for c in df.columns}, f"{prefix}{base}"
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def utf8_bytes(col: str | Column) -> Column:
    return F.octet_length(text_of(col)).cast("long")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the JVM's fast path; there, both mean the same."""
    pure = F.octet_length(col) == F.char_length(col)
    return F.when(pure, F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def count_space_words(col: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    trimmed = F.regexp_replace(text_of(col), rf"^{SPACE}+", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.array_remove(F.split(trimmed, rf"{SPACE}+"), ""))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: the optimizer would else put it inside a lambda, to run for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
