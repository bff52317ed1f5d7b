"""Shell-style globs as regular expressions.

``*`` crosses ``/``, ``?`` is any character, ``[seq]`` and ``[!seq]`` are sets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = "(?!)"


def _char(c: str) -> str:
    return c if c.isascii() and c.isalnum() else rf"\x{{{ord(c):x}}}"


def _char_set(body: str) -> str:
    negated = body.startswith("!")
    body = body[1:] if negated else body
    members, i = [], 0
    while i < len(body):
        if body[i + 1:i + 2] == "-" and i + 2 < len(body):
            low, high = body[i], body[i + 2]
            if low <= high:
                members.append(f"{_char(low)}-{_char(high)}")
            i += 3
        else:
            members.append(_char(body[i]))
            i += 1
    if not members:
        return "." if negated else NEVER
    return f"[{'^' if negated else ''}{''.join(members)}]"


def glob_to_regex(glob: str) -> str:
    """Unanchored Java regex of a glob. Each inner ``*`` is atomic: the nearest
    match of the text after it is always good enough, so there is no backtracking."""
    pieces, current, i = [], "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            pieces.append(current)
            current = ""
        elif c == "?":
            current += "."
        elif c == "[":
            # a "]" right after the opening (or after "!") belongs to the set
            start = i + 1 if glob[i:i + 1] == "!" else i
            end = glob.find("]", start + 1)
            if end < 0:
                current += _char("[")
            else:
                current += _char_set(glob[i:end])
                i = end + 1
        else:
            current += _char(c)
    if not pieces:
        return current
    inner = "".join(f"(?>.*?{piece})" for piece in pieces[1:] if piece)
    return f"{pieces[0]}{inner}.*{current}"


def globs_to_regex(globs) -> str | None:
    """One anchored regex that matches what any of the globs matches."""
    parts = [glob_to_regex(g) for g in globs]
    return rf"(?s)\A(?:{'|'.join(parts)})\z" if parts else None


def any_glob_regex(globs: Column) -> Column:
    """``array<string>`` of globs to one regex; meant for small rule tables."""

    @F.pandas_udf("string")
    def convert(lists: pd.Series) -> pd.Series:
        return lists.map(globs_to_regex, na_action="ignore")

    return convert(globs)
