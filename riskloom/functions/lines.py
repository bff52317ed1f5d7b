"""Lines of many quoted names in one text, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def first_lines(text: str | None, names: Sequence[str] | None) -> list[int | None] | None:
    """For each name the line of the first ``"name"`` in the text, None where there is none.

    What stands between two neighbouring quotes is looked at once, and its first line kept
    if it is one of the names, so the work is that of one look at the text, however many
    names there are. A name that holds a quote itself can't stand between neighbouring
    ones; it is searched for on its own.
    """
    if text is None or names is None:
        return None
    wanted = dict.fromkeys(names)
    line, between = 1, text.split('"')
    for i, part in enumerate(between):
        if 0 < i < len(between) - 1 and part in wanted and wanted[part] is None:
            wanted[part] = line
        line += part.count("\n")
    for name in wanted:
        if name is not None and '"' in name and (at := text.find(f'"{name}"')) >= 0:
            wanted[name] = text.count("\n", 0, at) + 1
    return [wanted[name] for name in names]


def quoted_lines(text: Column, names: Column) -> Column:
    """``first_lines`` as a column: ``array<int>`` beside ``names``."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def lines(texts: pa.Array, listed: pa.Array) -> pa.Array:
        out = [first_lines(t, n) for t, n in zip(texts.to_pylist(), listed.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.int32()))

    return lines(text, F.when(text.isNotNull(), names))
