"""Substring dedup by seed and extend, over words.

A word goes where a run of ``least`` words that also begins in a document of smaller id
covers it. Seeds are *winnowed anchors*: of the ``ANCHOR``-word hashes in a run of
``least`` words the smallest one. Equal runs choose equal anchors at equal places, so
documents are joined on anchors alone, about one for every 17 words, and no repeat of
the wanted length is missed.

A seed is extended both ways to its *context*: all runs of ``least`` words that chose it,
that is up to ``least - ANCHOR`` words on each side. Documents with equal contexts match
over the whole of it. Of each group of equal contexts only the document of the smallest
id goes on; where an anchor has several contexts, these are extended word by word: each
of their runs is matched by its own hash. Matched runs that overlap or touch are one
maximal repeat.

Matching is by groups, never by pairs: a passage that a third of all documents share
costs one aggregate row for each of its runs and task. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import (
    BETWEEN_SPACES, Words, as_long, long_run_hashes, mix, pieces, split_words,
)
from riskloom.storage import materialize

ANCHOR = 18
PIECE = 4 << 20
_CHUNK = 1 << 15

RUNS_SCHEMA = (
    "doc_id long, key long, n_words long, kept_sha256 string, "
    "runs array<struct<anchor: long, context: long, low: int, high: int>>"
)
_SPANS = "array<struct<low: int, high: int>>"


def _chosen(anchors: np.ndarray, n: int, choices: int) -> np.ndarray:
    """For each of ``n`` runs the place of its anchor: the leftmost smallest hash."""
    out = np.empty(n, np.int64)
    for low in range(0, n, _CHUNK):
        high = min(low + _CHUNK, n)
        view = np.lib.stride_tricks.sliding_window_view(anchors[low : high + choices - 1], choices)
        out[low:high] = view.argmin(axis=1) + np.arange(low, high)
    return out


def _runs(words: Words, least: int) -> tuple[np.ndarray, ...]:
    """The contexts of all texts: anchor hash, context hash, first and last run (as
    places in their text), and the text."""
    spans = long_run_hashes(words.hashes, least)
    n = len(spans)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    text = np.searchsorted(words.first, np.arange(n), "right") - 1
    whole = np.arange(n) + least <= words.first[text + 1]
    anchors = long_run_hashes(words.hashes, ANCHOR)
    chosen = _chosen(anchors, n, least - ANCHOR + 1)
    own = np.flatnonzero(whole)
    if not len(own):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.ones(len(own), bool)
    new[1:] = (chosen[own[1:]] != chosen[own[:-1]]) | (text[own[1:]] != text[own[:-1]])
    low = own[new]
    high = own[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)]
    at = chosen[low]
    shape = ((at - low) * 1000 + (high - low)).astype(np.uint64)
    context = mix(spans[low] + mix(spans[high] + mix(shape)))
    begin = words.first[text[low]]
    return as_long(anchors[at]), as_long(context), low - begin, high - begin, text[low]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _describe(least: int):
    run_type = pa.list_(pa.struct([
        ("anchor", pa.int64()), ("context", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                words = split_words(piece.column(1), BETWEEN_SPACES, lower=False)
                anchor, context, low, high, text = _runs(words, least)
                ends = np.searchsorted(text, np.arange(piece.num_rows + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays(
                    [pa.array(anchor), pa.array(context), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                    fields=list(run_type.value_type),
                )
                texts = piece.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(2), pa.array(words.counts, pa.int64()),
                    pa.array([_digest((t or "").encode().split()) for t in texts]),
                    pa.ListArray.from_arrays(pa.array(ends), items).cast(run_type),
                ], ["doc_id", "key", "n_words", "kept_sha256", "runs"])

    return run


def _extend(least: int):
    """For texts with open contexts, the hash of each of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                words = split_words(piece.column(1), BETWEEN_SPACES, lower=False)
                hashes = as_long(long_run_hashes(words.hashes, least))
                places, spans = [], []
                for i, opened in enumerate(piece.column(4).to_pylist()):
                    own = [np.arange(s["low"], s["high"] + 1) for s in opened or ()]
                    begin, n = int(words.first[i]), int(words.counts[i]) - least + 1
                    own = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
                    own = own[own < n]
                    places.append(own)
                    spans.append(hashes[own + begin])
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(1), piece.column(2), piece.column(3),
                    pa.array(places, pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int64())),
                ], ["doc_id", "text", "key", "whole", "places", "hashes"])

    return run


def _remove(least: int):
    def covered(n: int, spans: list[dict], starts: list[int]) -> np.ndarray:
        edges = np.zeros(n + 1, np.int64)
        for low, high in [(s["low"], s["high"]) for s in spans or ()] + [(s, s) for s in starts or ()]:
            edges[min(low, n)] += 1
            edges[min(high + least, n)] -= 1
        return np.cumsum(edges[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "key": [], "n_words": [], "kept_text": [], "repeats": []}
            for row in batch.to_pylist():
                words = (row["text"] or "").encode().split()
                gone = covered(len(words), row["whole"], row["starts"])
                turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                out["doc_id"].append(row["doc_id"])
                out["key"].append(row["key"])
                out["n_words"].append(len(words))
                out["kept_text"].append(b" ".join(compress(words, ~gone)).decode())
                out["repeats"].append(
                    [{"low": int(a), "high": int(b) - 1} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                )
            yield pa.RecordBatch.from_arrays([
                pa.array(out["doc_id"], pa.int64()), pa.array(out["key"], pa.int64()),
                pa.array(out["n_words"], pa.int64()), pa.array(out["kept_text"], pa.string()),
                pa.array(out["repeats"], pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))),
            ], ["doc_id", "key", "n_words", "kept_text", "repeats"])

    return run


def _shared_runs(described: DataFrame) -> DataFrame:
    """The contexts whose anchor occurs in several documents."""
    runs = described.where("doc_id is not null").select("doc_id", "key", F.inline("runs"))
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    # stored, so that the join has plain shuffles on both sides, which Spark can split
    return materialize(runs.join(materialize(shared.select("anchor")), "anchor"))


def _matches(runs: DataFrame) -> DataFrame:
    """For each document the contexts that a smaller one matches (``whole``) and those to
    be extended word by word (``opened``)."""
    groups = materialize(
        runs.groupBy("anchor", "context").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    )
    several = groups.groupBy("anchor").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b")
    several = materialize(several.select("anchor", F.lit(True).alias("open")))
    known = groups.join(several, "anchor", "left").where("open or first < last")
    joined = runs.join(materialize(known), ["anchor", "context"])
    span = F.struct("low", "high")
    return joined.groupBy("doc_id", "key").agg(
        F.collect_list(F.when(F.col("doc_id") > F.col("first"), span)).cast(_SPANS).alias("whole"),
        F.collect_list(F.when(F.col("open") & (F.col("doc_id") == F.col("first")), span)).cast(_SPANS).alias("opened"),
    ).where("size(whole) > 0 or size(opened) > 0")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50
) -> tuple[DataFrame, DataFrame]:
    """Two tables. The documents without repeats: ``doc_id, n_words, kept_sha256``. Those
    with repeats: ``doc_id, n_words, kept_text, repeats``, where ``repeats`` are the
    maximal spans (word places from 0, both ends included) that went, and ``kept_text``
    are the other words joined by one space. ``remaining`` makes them one.

    Words are split at white space and compared as they are. Runs are judged on the
    input, not on what is left. Null, empty and short texts have no run. Repeats inside
    one document stay. Rows that share an id are one document: their texts aren't matched
    with each other. A row without an id is neither a source nor changed. Repeated rows are
    repeated in the result. Other columns are not read. Runs are compared by 64-bit hash.
    """
    if not ANCHOR < least < 256:
        raise ValueError(f"least must be over {ANCHOR} and under 256")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))  # tells texts of one id apart
    described = materialize(texts.mapInArrow(_describe(least), RUNS_SCHEMA))
    found = materialize(_matches(_shared_runs(described)))

    extended = texts.join(found, ["doc_id", "key"]).select("doc_id", "text", "key", "whole", "opened").mapInArrow(
        _extend(least), f"doc_id long, text string, key long, whole {_SPANS}, places array<int>, hashes array<long>"
    )
    extended = materialize(extended.withColumn("row", F.monotonically_increasing_id()))
    runs = extended.select("row", "doc_id", F.inline(F.arrays_zip("places", "hashes")).alias("place", "hash"))
    first = materialize(
        runs.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    )
    starts = (
        runs.join(first, "hash").where("doc_id > first")
        .groupBy("row").agg(F.collect_list("place").alias("starts"))
    )
    cut = extended.select("row", "doc_id", "key", "text", "whole").join(starts, "row", "left").where(
        "size(whole) > 0 or size(starts) > 0"
    )
    with_repeats = materialize(
        cut.select("doc_id", "key", "text", "whole", "starts").mapInArrow(
            _remove(least), f"doc_id long, key long, n_words long, kept_text string, repeats {_SPANS}"
        )
    )
    untouched = described.select("doc_id", "key", "n_words", "kept_sha256").join(
        with_repeats.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti"
    )
    return untouched.drop("key"), with_repeats.drop("key")


def remaining(untouched: DataFrame, with_repeats: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every document."""
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda s, r: s + r["high"] - r["low"] + 1)
    return untouched.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").union(
        with_repeats.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256))
    )
