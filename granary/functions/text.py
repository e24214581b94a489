"""Text expressions for documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The part of a path after the last slash."""
    return F.split_part(path, F.lit("/"), F.lit(-1))


def words(text: Column) -> Column:
    """The whitespace-separated words of a text, none for blank text."""
    return F.array_remove(F.split(text, r"\s+"), "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, the tokens that search compares."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
