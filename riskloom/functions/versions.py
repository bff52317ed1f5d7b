"""Dotted version numbers as comparable arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import let

#: Signs that no integer holds, and empty parts: most texts that are no version have one of
#: them. A failed cast makes an exception each time, which costs more than all else here.
_NO_VERSION = r"[A-Za-z<>=*^~|]|[.][.]|^[.]|[.]$|^$"


def parse_version(version: Column) -> Column:
    """``array<bigint>``, or NULL unless every part is an integer.

    Arrays compare element by element and a shorter prefix is smaller, so
    ``2.31 < 2.31.0``.
    """
    parts = F.transform(
        F.split(version, "[.]"), lambda part: F.trim(part).try_cast("bigint")
    )
    whole = let(parts, lambda p: F.when(~F.exists(p, lambda part: part.isNull()), p))
    return F.when(~F.rlike(version, F.lit(_NO_VERSION)), whole)

