"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space and \t \n \v \f \r, the white space that the text operators know.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (compared without case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` less the columns whose names an operator's outputs take; the outputs win."""
    lower = {x.lower() for x in outputs}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def normal_space(text: Column | str) -> Column:
    """Text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE_RUN, " ")
