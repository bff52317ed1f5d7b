"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table of *segments*. A segment covers some consecutive documents of
one task, a few megabytes of text, and holds for each term its posting list: the places
of the term in the segment, ascending. Documents lie in one row of places with a gap
after each, so that no phrase reaches from one into the next. Segments need no shuffle,
are written once to the shared folder, and are searched where Spark places them.

Lists are kept for the terms of the test sets only, as others would never be read; this
set of terms is broadcast, in blocks of bounded size (``BLOCK_WORDS``) that are indexed
and searched one after another, so a test set may be of any size.

A search goes through the phrases of each test item. It starts from the phrase's rarest
term by corpus frequency, takes its posting list less the term's offset in the phrase as
candidate starts, and intersects it with the offset-adjusted lists of the next rarest
terms until the phrase is through or no candidate is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import LETTERS_DIGITS, as_long, pieces, split_words
from riskloom.storage import materialize

#: Bytes of text in a segment, unless one document has more.
SEGMENT_BYTES = 4 << 20
#: Words of test items that are searched for at a time, at 8 bytes a word.
BLOCK_WORDS = 1 << 20
#: Bits of the table that tells quickly which words can be terms.
_FILTER_BITS = 22

SEGMENTS_SCHEMA = (
    "doc_ids array<long>, first array<long>, n_words array<long>, "
    "terms array<long>, list_ends array<int>, places array<int>"
)
MATCHES_SCHEMA = (
    "segment long, doc int, doc_id long, n_words long, "
    "spans array<struct<first: long, last: long>>, items array<long>"
)


def _index(terms: np.ndarray, gap: int):
    """``terms``: the hashes to keep, ascending."""
    maybe = np.zeros(1 << _FILTER_BITS, bool)
    low = np.uint64((1 << _FILTER_BITS) - 1)
    maybe[(terms & low).astype(np.int64)] = True

    def segment(batch: pa.RecordBatch) -> dict:
        words = split_words(batch.column(1), LETTERS_DIGITS, lower=True)
        own = np.flatnonzero(maybe.take((words.hashes & low).astype(np.int64)))
        at = np.minimum(np.searchsorted(terms, words.hashes[own]), max(len(terms) - 1, 0))
        same = terms[at] == words.hashes[own] if len(terms) else np.zeros(0, bool)
        own, at = own[same], at[same]
        doc = np.searchsorted(words.first, own, "right") - 1
        places = own + doc * gap
        order = np.argsort(at, kind="stable")
        kept, counts = np.unique(at, return_counts=True)
        return {
            "doc_ids": batch.column(0).to_pylist(),
            "first": words.first[:-1] + np.arange(batch.num_rows) * gap,
            "n_words": words.counts,
            "terms": as_long(terms[kept]),
            "list_ends": np.cumsum(counts).astype(np.int32),
            "places": places[order].astype(np.int32),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        types = {"list_ends": ints, "places": ints}
        for batch in batches:
            for piece in pieces(batch, 1, SEGMENT_BYTES):
                yield pa.RecordBatch.from_pydict(
                    {k: pa.array([v], types.get(k, longs)) for k, v in segment(piece).items()}
                )

    return run


@dataclass
class Phrases:
    """The phrases to look for: of phrase ``i`` the item, the term hashes in order of
    rarity, and the offset of each in the phrase."""

    items: list[int]
    lengths: list[int]
    terms: list[np.ndarray]
    offsets: list[np.ndarray]


def _phrases(item_ids: list[int], words: list[np.ndarray], window: int, frequency: dict[int, int]) -> Phrases:
    out = Phrases([], [], [], [])
    for item, hashes in zip(item_ids, words, strict=True):
        rarity = np.array([frequency.get(h, 0) for h in hashes.tolist()], np.int64)
        for low in range(max(1, len(hashes) - window + 1)):
            part = slice(low, low + window)
            if not len(hashes[part]) or not rarity[part].all():
                continue  # a term that no document has
            order = np.argsort(rarity[part], kind="stable")
            out.items.append(item)
            out.lengths.append(len(hashes[part]))
            out.terms.append(hashes[part][order])
            out.offsets.append(order)
    return out


def _starts(lists: dict[int, np.ndarray], terms: list[int], offsets: list[int], slop: int) -> np.ndarray:
    """Where a phrase begins in the segment: each of its terms lies at most ``slop``
    places from where the phrase's begin puts it."""
    found = lists[terms[0]] - offsets[0]
    if slop:  # the rarest term itself may be out of its place
        found = np.unique((found[:, None] + np.arange(-slop, slop + 1)).ravel())
    for term, offset in zip(terms[1:], offsets[1:], strict=True):
        own = lists[term]
        at = np.searchsorted(own, found + (offset - slop))
        at[at == len(own)] = len(own) - 1
        found = found[np.abs(own[at] - found - offset) <= slop]
        if not len(found):
            break
    return found


def _search(phrases: Phrases, slop: int):
    todo = [
        (item, length, terms.view(np.int64).tolist(), offsets.tolist())
        for item, length, terms, offsets in zip(
            phrases.items, phrases.lengths, phrases.terms, phrases.offsets, strict=True
        )
    ]

    def one(row: dict) -> dict:
        ends = np.array(row["list_ends"], np.int64)
        places = np.array(row["places"], np.int64)
        lists = dict(zip(row["terms"], np.split(places, ends[:-1]) if len(ends) else [], strict=True))
        first, counts = np.array(row["first"], np.int64), np.array(row["n_words"], np.int64)
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for item, length, terms, offsets in todo:
            if terms[0] not in lists or not all(t in lists for t in terms):
                continue
            starts = _starts(lists, terms, offsets, slop)
            if not len(starts):
                continue
            docs = np.searchsorted(first, starts, "right") - 1
            for start, doc in zip(starts.tolist(), docs.tolist(), strict=True):
                low = max(start - slop - int(first[doc]), 0)
                high = min(start + length - 1 + slop - int(first[doc]), int(counts[doc]) - 1)
                spans.setdefault(doc, []).append((low, high))
                items.setdefault(doc, set()).add(item)
        n = len(counts)
        return {
            "doc": list(range(n)), "doc_id": row["doc_ids"], "n_words": row["n_words"],
            "spans": [_joined(spans.get(i, [])) for i in range(n)],
            "items": [sorted(items.get(i, ())) for i in range(n)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                out = one(row)
                n = len(out["doc"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["segment"]] * n, pa.int64()), pa.array(out["doc"], pa.int32()),
                    pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                    pa.array(out["spans"], span), pa.array(out["items"], pa.list_(pa.int64())),
                ], ["segment", "doc", "doc_id", "n_words", "spans", "items"])

    return run


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    """Overlapping and touching spans made one."""
    out: list[dict] = []
    for low, high in sorted(spans):
        if out and low <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], high)
        else:
            out.append({"first": low, "last": high})
    return out


def _hashed(texts: list[str | None]) -> list[np.ndarray]:
    words = split_words(pa.array(texts, pa.string()), LETTERS_DIGITS, lower=True)
    return [words.hashes[words.of(i)] for i in range(len(texts))]


def build_index(docs: DataFrame, terms: np.ndarray, window: int, slop: int = 0) -> DataFrame:
    """The stored segments of ``docs`` (``doc_id, text``), with lists for ``terms``."""
    index = docs.mapInArrow(_index(np.unique(terms), window + 2 * slop + 1), SEGMENTS_SCHEMA)
    return materialize(index.withColumn("segment", F.monotonically_increasing_id()))


def _frequencies(index: DataFrame) -> dict[int, int]:
    """How often each kept term occurs in the corpus: as many rows as kept terms."""
    size = F.expr("element_at(list_ends, i + 1) - if(i = 0, 0, element_at(list_ends, i))")
    lists = index.select("list_ends", F.posexplode("terms").alias("i", "term"))
    counted = lists.groupBy("term").agg(F.sum(size).alias("n")).toPandas()
    return dict(zip(counted["term"].to_numpy(np.int64).view(np.uint64).tolist(), counted["n"].tolist(), strict=True))


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The test items, a block of about ``BLOCK_WORDS`` words at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    ids, texts, size = [], [], 0
    for row in items.where("item_id is not null").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"] or "") // 4
        if size >= BLOCK_WORDS:
            yield ids, _hashed(texts)
            ids, texts, size = [], [], 0
    yield ids, _hashed(texts)


def phrase_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, slop: int = 0,
) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every row of ``docs``.

    Words are runs of ASCII letters and digits and of any character beyond ASCII, A-Z in
    lower case. The phrases of an item are its ``window`` consecutive words; an item of
    fewer words is one phrase, one of none has none. With ``slop`` 0 a match is exact;
    else every term may lie up to ``slop`` words from its place (a proximity match, whose
    span is widened by ``slop``). ``spans`` are the word places (from 0, both ends
    included) covered by matches, overlapping ones made one; ``items`` the ids of the
    items matched, ascending. Null and empty texts have no words and no match. Repeated
    rows are repeated in the result; a null id stays null. Items without an id are not
    looked for; rows of ``benchmark`` with one id are texts of one item. An empty
    ``benchmark`` matches nothing. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for ids, hashes in _item_blocks(benchmark, item_id_col, item_text_col):
        terms = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        index = build_index(texts, terms, window, slop)
        phrases = _phrases(ids, hashes, window, _frequencies(index))
        part = index.mapInArrow(_search(phrases, slop), MATCHES_SCHEMA)
        found = part if found is None else found.unionByName(part)
        if found is not part:  # the same segments in every block: rows meet by their place
            merged = found.groupBy("segment", "doc").agg(
                F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                F.flatten(F.collect_list("spans")).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            )
            found = materialize(merged)
    return found.select("doc_id", "n_words", "spans", "items")


def contamination(matches: DataFrame, percent: int = 5) -> DataFrame:
    """The contract's figures of each row of ``phrase_matches``: ``n_hit`` document words
    lie in a match, and a document is contaminated when these are ``percent`` of its
    words or more."""
    covered = F.size(F.array_distinct(F.expr("flatten(transform(spans, s -> sequence(s.first, s.last)))")))
    listed = F.array_join(F.array_sort(F.expr("transform(items, i -> cast(i as string))")), ",")
    figures = matches.select(
        "doc_id", "n_words", F.when(F.size("spans") > 0, covered).otherwise(0).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "spans", "items",
    )
    return figures.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    )
