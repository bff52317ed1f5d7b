"""Words of whole texts as arrays: byte places and 64-bit hashes, without a Python loop
per word.

A batch of texts arrives as one Arrow column, that is one run of UTF-8 bytes. Words are
found by a table over byte values, so a separator must be an ASCII character. Bytes are
taken in blocks: memory beyond the batch is a few megabytes plus 24 bytes a word,
however long one text or one word is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 17
_PLACES = 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Anything between white space of [\x20\x09-\x0D].
BETWEEN_SPACES = ~_SPACE
#: ASCII letters and digits, and every character beyond ASCII.
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _noise(numbers: np.ndarray, seed: int) -> np.ndarray:
    return mix((numbers.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_FACTORS = _noise(np.arange(_PLACES), 1 << 40) | np.uint64(1)


def factors(places: np.ndarray) -> np.ndarray:
    if len(places) and int(places.max()) >= _PLACES:
        return _noise(places, 1 << 40) | np.uint64(1)
    return _FACTORS.take(places)


def byte_values(is_word: np.ndarray, lower: bool) -> np.ndarray:
    values = _noise(np.arange(256), 1 << 20)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    values[~is_word] = 0
    return values


@dataclass
class Words:
    """``first[i]:first[i + 1]`` are the words of text ``i``; ``starts`` count from the
    beginning of ``data``."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), places


def split_words(texts: pa.Array, is_word: np.ndarray, lower: bool) -> Words:
    data, places = text_bytes(texts)
    begin, end = int(places[0]), int(places[-1])
    found = []
    for low in range(begin, end, BLOCK):
        high = min(low + BLOCK, end)
        inside = is_word.take(data[low:high])
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        if low > begin and is_word[data[low - 1]]:
            opens[0] = False
        edges = places[np.searchsorted(places, low) : np.searchsorted(places, high)] - low
        opens[edges] |= inside[edges]
        found.append(np.flatnonzero(opens) + low)
    starts = np.concatenate(found) if found else np.zeros(0, np.int64)
    hashes = np.zeros(len(starts), np.uint64)
    lengths = np.zeros(len(starts), np.int64)
    values = byte_values(is_word, lower)
    for low in range(int(starts[0]) if len(starts) else end, end, BLOCK):
        high = min(low + BLOCK, end)
        own = slice(int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high)))
        here = np.maximum(starts[own], low) - low
        block = data[low:high]
        inside = is_word.take(block)
        place = np.arange(low, high) - np.repeat(starts[own], np.diff(np.append(here, high - low)))
        place[~inside] = 0
        hashes[own] += np.add.reduceat(values.take(block) * factors(place), here)
        lengths[own] += np.add.reduceat(inside.astype(np.int64), here)
    hashes = mix(hashes + lengths.astype(np.uint64))
    return Words(data, starts, lengths, hashes, np.searchsorted(starts, places))


_STEPS = _noise(np.arange(256), 1 << 50) | np.uint64(1)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive words, from its first word on."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * _STEPS[i]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a whole sequence, of under 256 words."""
    return mix((hashes * _STEPS[: len(hashes)]).sum(keepdims=True) ^ np.uint64(len(hashes)))[0]


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most_bytes`` of text; a row stays whole."""
    _, places = text_bytes(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(places, places[low] + most_bytes, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def long_run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """As ``run_hashes``, in fewer steps: runs of runs."""
    inner = max(i for i in range(1, int(size**0.5) + 1) if size % i == 0)
    outer = size // inner
    parts = run_hashes(hashes, inner)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(outer):
        total += parts[i * inner : i * inner + n] * _STEPS[i]
    return mix(total)
