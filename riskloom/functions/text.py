"""Text functions: decoding, case folding, line numbers.

Patterns follow Python's ``re`` on ``str``. Java differs in three ways, handled
here once: ``.`` must stop at ``\\n`` only (flag ``d``), white space is Unicode
white space plus U+001C-U+001F, and a word character is a letter, number or ``_``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules

SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
WORD_END = rf"(?!{WORD})"

# The four non-ASCII letters that equal an ASCII letter when case
# is ignored, and their ASCII counterparts.
FOLD_FROM = "İıſK"
FOLD_TO = "iisk"

_ESCAPE = "\x1a"
_REPLACEMENT = "�"


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Python-style pattern (ASCII literals, ``\\s``, ``\\S``) to a Java one."""
    if pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[4:], True
    pattern = pattern.replace(r"[^\"'\s]", r"[^\"'\s\x1c-\x1f]")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            pair = pattern[i:i + 2]
            out.append(pair if in_class else {r"\s": SPACE, r"\S": NOT_SPACE}.get(pair, pair))
            i += 2
            continue
        if pattern[i] in "[]":
            in_class = pattern[i] == "["
        out.append(pattern[i])
        i += 1
    return ("(?idU)" if ignore_case else "(?dU)") + "".join(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body``
    uses it. An expression used twice inside a lambda is otherwise computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_ascii(text: Column) -> Column:
    return F.char_length(text) == F.octet_length(text)


def fold(text: Column) -> Column:
    """Lower-case text such that a lower-case ASCII literal occurs in the result
    exactly where it matches the input with case ignored. Keeps code-point counts,
    so bounded gaps still measure the same distance."""
    special = F.lit(False)
    for letter in FOLD_FROM:
        special = special | F.contains(text, F.lit(letter))
    return F.when(is_ascii(text) | ~special, F.lower(text)).otherwise(
        F.lower(F.translate(text, FOLD_FROM, FOLD_TO))
    )


def newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_of_literal(text: Column, literal: Column) -> Column:
    """Line of the first occurrence of a literal known to occur."""
    return newlines(F.call_function("substring_index", text, literal, F.lit(1))) + 1


def line_of_regex(text: Column, pattern: Column) -> Column:
    """Line of the first match of a pattern known to match."""
    return newlines(F.get(F.split(text, pattern, 2), 0)) + 1


def match_lines(text: Column, pattern: Column) -> Column:
    """Line numbers of all matches, aligned with ``regexp_extract_all``.

    The text between matches is reduced to its newlines with a mark per match; the
    mark's position among the newlines is the line. Linear in the text.
    """

    def only_newlines(part):
        return F.regexp_replace(part, "[^\n]+", "")

    marked = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda between, match: F.when(
            match.isNotNull(), F.concat(only_newlines(between), F.lit("|"), only_newlines(match))
        ),
    )
    per_line = F.split(F.array_join(marked, ""), "\n")
    return F.flatten(
        F.transform(per_line, lambda marks, i: F.array_repeat(i + 1, F.length(marks)))
    )


def universal_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def _drop_invalid(raw: Column) -> Column:
    """Drop the bytes that are not valid UTF-8.

    ``make_valid_utf8`` marks them with U+FFFD; a U+FFFD already in the text is
    escaped first, so that only the marks are removed.
    """

    def swap(text, old, new):
        return F.replace(text, F.lit(old), F.lit(new))

    escaped = swap(swap(raw, _ESCAPE, _ESCAPE + "0"), _REPLACEMENT, _ESCAPE + "1")
    cleaned = swap(F.make_valid_utf8(escaped), _REPLACEMENT, "")
    return swap(swap(cleaned, _ESCAPE + "1", _REPLACEMENT), _ESCAPE + "0", _ESCAPE)


def decode_utf8(content: Column) -> Column:
    """Bytes as UTF-8 text, invalid bytes dropped; never fails."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(_drop_invalid(raw))


def has_utf16_mark(content: Column) -> Column:
    return F.startswith(content, F.lit(bytearray(b"\xff\xfe"))) | F.startswith(
        content, F.lit(bytearray(b"\xfe\xff"))
    )


def is_binary(content: Column) -> Column:
    """Binary test on the first 1,024 bytes of content without a UTF-16 mark.

    A character cut by the probe's end is judged by its remaining bytes, so a text
    file is not taken for binary because of where it was cut.
    """
    probe = F.substring(content, 1, rules.BINARY_PROBE_BYTES)
    whole = F.lit(False)
    for extra in range(4):
        part = F.substring(content, 1, rules.BINARY_PROBE_BYTES + extra)
        whole = whole | F.is_valid_utf8(part.cast("string"))
    return content.isNull() | F.contains(probe, F.lit(bytearray(b"\x00"))) | ~whole


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Last extension with its dot; empty for names that only start with a dot."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def file_type(path: Column) -> Column:
    suffix = file_suffix(path)
    return F.when(suffix == "", "unknown").otherwise(suffix)


def language(extension: Column) -> Column:
    by_extension = F.from_json(F.lit(json.dumps(rules.LANGUAGE_BY_EXTENSION)), "map<string,string>")
    return F.coalesce(F.try_element_at(by_extension, F.lower(extension)), F.lit("unknown"))


def mask(value: Column) -> Column:
    """First four characters, the rest hidden."""
    return F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), F.greatest(F.length(value) - 4, F.lit(0))))
