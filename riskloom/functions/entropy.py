"""Shannon entropy in bits per byte.

Counting bytes has no built-in; numpy does it in Arrow batches, for many short values at
once. Callers pass NULL for rows that need no answer, so that their bytes never leave the
JVM.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules

#: Values that are counted at once: together so many bytes, and so many values.
BYTES_AT_ONCE, VALUES_AT_ONCE = 1 << 20, 1 << 12


def byte_entropy(data: bytes) -> float:
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8))
    share = counts[counts > 0] / len(data)
    return float(abs((share * np.log2(share)).sum()))


def byte_entropies(values: pa.Array) -> pa.Array:
    """:func:`byte_entropy` of each binary value; NULL stays NULL."""
    wide = values.cast(pa.large_binary())
    _, offsets, flat = wide.buffers()
    n = len(wide)
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(flat, np.uint8) if flat is not None else np.zeros(0, np.uint8)
    out, first = np.zeros(n), 0
    while first < n:
        within = int(np.searchsorted(at, at[first] + BYTES_AT_ONCE, "right")) - 1
        last = max(first + 1, min(within, first + VALUES_AT_ONCE))
        part, sizes = data[at[first] : at[last]], np.diff(at[first : last + 1])
        if last == first + 1:
            out[first] = byte_entropy(memoryview(part))
        else:
            counts = np.bincount((np.repeat(np.arange(last - first), sizes) << 8) + part, minlength=1)
            cells = np.flatnonzero(counts)
            share = counts[cells] / sizes[cells >> 8]
            out[first:last] = np.abs(np.bincount(cells >> 8, share * np.log2(share), last - first))
        first = last
    return pa.array(out, mask=wide.is_null().to_numpy(zero_copy_only=False))


def entropy(content: Column, sample_bytes: int = 0) -> Column:
    """Entropy of the bytes, or of the first ``sample_bytes`` of them; NULL stays NULL."""

    @F.arrow_udf("double")
    def of_bytes(values: pa.Array) -> pa.Array:
        return byte_entropies(values)

    return of_bytes(F.substring(content, 1, sample_bytes) if sample_bytes > 0 else content)


def byte_counts(content: Column) -> Column:
    """How often each byte value that occurs does: ``256 * count + value`` for each, in
    order of value; NULL stays NULL. Counts of parts add up to the counts of the whole."""

    def count(data: bytes) -> np.ndarray:
        counts = np.bincount(np.frombuffer(data, dtype=np.uint8))
        values = np.flatnonzero(counts)
        return counts[values] * 256 + values

    @F.arrow_udf("array<bigint>")
    def of_bytes(values: pa.Array) -> pa.Array:
        return pa.array([None if data is None else count(data) for data in values.to_pylist()], pa.list_(pa.int64()))

    return of_bytes(content)


def entropy_of_counts(counts: Column) -> Column:
    """Entropy from :func:`byte_counts`; NULL if there are none."""
    n = lambda x: F.shiftright(x, 8)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + n(x))
    weighted = F.aggregate(counts, F.lit(0.0), lambda s, x: s + n(x) * F.log2(n(x)))
    return F.abs(F.log2(total) - weighted / total)


def may_have_high_entropy(content: Column) -> Column:
    """False only where entropy cannot exceed the limit of 7.5 bits: n bytes hold at
    most log2(n) bits, and ASCII at most 7."""
    raw = content.cast("string")
    ascii_only = F.is_valid_utf8(raw) & (F.char_length(raw) == F.octet_length(content))
    return (F.octet_length(content) > int(2**rules.HIGH_ENTROPY)) & ~ascii_only


def _qualified(runs) -> tuple[int, str | None]:
    good = [run for run in runs if byte_entropy(run.encode()) >= rules.BASE64_MIN_ENTROPY]
    return len(good), good[0] if good else None


def _columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Tuples as a struct, whose fields are NULL in rows without an answer."""
    fields = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds.values(), strict=True)], list(kinds))


def _without(values: pa.Array, kinds: dict[str, pa.DataType]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.nulls(len(values), k) for k in kinds.values()], list(kinds))


_RUNS = {"n": pa.int32(), "first": pa.string()}
_UTF16 = {"text": pa.string(), **_RUNS}


def high_entropy_runs(runs: Column) -> Column:
    """``struct<n, first>``: how many of the strings reach the base64 entropy floor,
    and the first that does."""

    @F.arrow_udf("n int, first string")
    def qualify(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return _without(values, _RUNS)
        return _columns([(None, None) if runs is None else _qualified(runs) for runs in values.to_pylist()], _RUNS)

    return qualify(runs)


def utf16(content: Column) -> Column:
    """``struct<text, n, first>`` of UTF-16 content: its text, and what
    :func:`high_entropy_runs` finds in it. ``text`` is NULL if the head of the content
    is not valid UTF-16.

    Callers pass NULL for content without a UTF-16 mark. The runs are found here
    because a second Python step on this step's result would make the optimizer fold
    the whole text expression into each use of it.
    """
    shaped = re.compile(rules.BASE64_RUN)

    def decode(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None
        try:
            cut = len(data) > rules.BINARY_PROBE_BYTES
            codecs.getincrementaldecoder("utf-16")().decode(
                data[: rules.BINARY_PROBE_BYTES], final=not cut
            )
        except UnicodeDecodeError:
            return None, None, None
        text = data.decode("utf-16", "ignore")
        return text, *_qualified(run for run in shaped.findall(text) if len(run) % 4 == 0)

    @F.arrow_udf("text string, n int, first string")
    def of_bytes(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return _without(values, _UTF16)
        return _columns([decode(data) for data in values.to_pylist()], _UTF16)

    return of_bytes(content)
