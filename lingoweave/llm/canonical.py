"""Letters and digits of a text, without case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_digits(text: Column) -> Column:
    """The letters (L) and digits (N) of a string in lower case, all else removed; null stays null.

    Upper case first, so that a letter with several lower or a longer upper form (ß) meets its other spelling. The step in between
    also keeps the optimizer from dropping the upper case as being undone.
    """
    upper = F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))
    return F.regexp_replace(F.translate(F.lower(upper), "ς", "σ"), r"[^\p{L}\p{N}]+", "")
