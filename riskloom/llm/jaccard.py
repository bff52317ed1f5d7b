"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A row of the matrix is a document's set of distinct word n-grams, a column an n-gram.
Two documents are linked when ``intersection >= similarity * union``. The product of the
matrix with its transpose is never formed whole:

1. Columns are put in one global order, those in many documents last. The *leading block*
   of a row is as many of its first columns as a linked pair can't both miss: of ``n``
   columns ``n - ceil(s n) + 1``, and ``n - ceil(2 s n / (1 + s)) + 1`` for the smaller of
   the two rows. Only leading blocks are multiplied by way of a shuffle on the column.
2. Pairs are discarded when their sizes, their places in the block, or the bound of their
   *bit rows* exclude the overlap that their sizes ask for. Of two rows no column before
   their first common one is shared, which bounds the overlap by what follows it. A bit row marks the columns modulo its width: each
   mark that the other row lacks is at least one column that the other row lacks.
3. The rest accumulate their overlap over the full rows, which decides exactly.

A group of copies never becomes all its pairs. Rows with equal sets are one row from the
start. Then each column joins its rows to two pivots only, each row is tested with the two that
it shares most columns with, and of all other pairs those in different components are
looked at afterwards. None of these is left out but those whose known distances to a
common pivot exclude a link by the triangle inequality, which Jaccard distances obey.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import connected_components
from riskloom.llm.words import BETWEEN_SPACES, as_long, mix, pieces, run_hashes, sequence_hash, split_words
from riskloom.storage import materialize

#: Bytes of text that a Python worker holds as arrays at a time (a longer text is whole).
PIECE = 4 << 20
#: A column found so often among so many columns of consecutive documents is a candidate
#: for the last places of the order, which has room for so many. The order decides cost,
#: never the result.
LOCALLY_COMMON, AMONG, COMMON_COLUMNS = 3, 4_000_000, 400_000
#: Rows that a task remembers in order not to send an equal row twice.
REMEMBERED = 200_000


def _column_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct columns, ascending."""
    words = split_words(texts, BETWEEN_SPACES, lower=True)
    runs = run_hashes(words.hashes, width)
    for i in range(len(texts)):
        own = words.of(i)
        n = own.stop - own.start
        if n >= width:
            yield np.unique(runs[own.start : own.stop - width + 1])
        elif n:
            yield np.array([sequence_hash(words.hashes[own])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _identity(columns: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix(columns).sum(keepdims=True), mix(columns ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True)
    return int(as_long(a)[0]), int(as_long(mix(b))[0])


def _bit_row(columns: np.ndarray) -> np.ndarray:
    """Two to four bits a column, in a power of two of 64-bit words."""
    bits = max(64, 1 << int(2 * len(columns) - 1).bit_length())
    row = np.zeros(bits, bool)
    row[(columns & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").view(np.int64)


ROWS_SCHEMA = (
    "doc_id long, n int, set_a long, set_b long, bits array<long>, common array<struct<column: long, times: long>>"
)


def _common_columns(sets: list[np.ndarray]) -> pa.RecordBatch:
    """One row, of no document, with the columns that many of the ``sets`` hold."""
    columns, times = np.unique(np.concatenate(sets), return_counts=True)
    often = times >= LOCALLY_COMMON
    pairs = pa.StructArray.from_arrays(
        [pa.array(as_long(columns[often])), pa.array(times[often])], ["column", "times"]
    )
    nothing = pa.array([None], pa.int64())
    return pa.RecordBatch.from_arrays([
        nothing, nothing.cast(pa.int32()), nothing, nothing, pa.array([None], pa.list_(pa.int64())),
        pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs),
    ], ["doc_id", "n", "set_a", "set_b", "bits", "common"])


def _describe(width: int):
    common_type = pa.list_(pa.struct([("column", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                sets = list(_column_sets(piece.column(1), width))
                names = [_identity(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column(0),
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "set_a": pa.array([a for a, _ in names], pa.int64()),
                    "set_b": pa.array([b for _, b in names], pa.int64()),
                    "bits": pa.array([_bit_row(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    "common": pa.nulls(len(sets), common_type),
                })
                for name, columns in zip(names, sets, strict=True):  # a copy doesn't make a column common
                    if len(columns) and name not in held:
                        held[name] = columns
                        size += len(columns)
                if size >= AMONG:
                    yield _common_columns(list(held.values()))
                    held, size = {}, 0
        if held:
            yield _common_columns(list(held.values()))

    return run


def _leading_columns(width: int, similarity: int, late: np.ndarray, places: np.ndarray):
    """``late``: the columns that come last, ascending, with their ``places`` in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                ids = piece.column(0).to_pylist()
                parts, owners, sizes = [], [], []
                for doc_id, columns in zip(ids, _column_sets(piece.column(1), width), strict=True):
                    n = len(columns)
                    if not n or doc_id is None or (name := _identity(columns)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    if len(late):
                        at = np.minimum(np.searchsorted(late, columns), len(late) - 1)
                        common = late[at] == columns
                        if common.any():
                            last = columns[common][np.argsort(places[at[common]])]
                            columns = np.concatenate([columns[~common], last])
                    parts.append(columns[: n - -(-similarity * n // 100) + 1])
                    owners.append(doc_id)
                    sizes.append(n)
                if parts:
                    counts = [len(p) for p in parts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(as_long(np.concatenate(parts))),
                        pa.array(np.repeat(np.array(owners, np.int64), counts)),
                        pa.array(np.repeat(np.array(sizes, np.int32), counts)),
                        pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts])),
                    ], ["column", "doc_id", "n", "place"])

    return run


def _full_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                sets = [as_long(s) for s in _column_sets(piece.column(1), width)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column(0), "columns": pa.array(sets, pa.list_(pa.int64())),
                })

    return run


class _Bounds:
    """What the sizes of two rows, ``x`` and ``y``, ask of their overlap, in percent."""

    def __init__(self, similarity: int):
        self.s = similarity

    def sizes(self, x: str, y: str):
        return F.expr(f"100 * least({x}, {y}) >= {self.s} * greatest({x}, {y})")

    def least_overlap(self, x: str, y: str) -> str:
        return f"ceil({self.s} * ({x} + {y}) / {100 + self.s}.0D - 1e-9)"

    def in_short_block(self, n: str, place: str):
        """A row's place is in the block that it needs against rows of its size and more."""
        return F.expr(f"{place} < {n} - ceil({2 * self.s} * {n} / {100 + self.s}.0D - 1e-9) + 1")

    def linked(self, overlap: str, x: str, y: str):
        return F.expr(f"100 * {overlap} >= {self.s} * ({x} + {y} - {overlap})")


def _bounded(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with their sizes and ``most``, what their bit rows allow of overlap."""
    x = rows.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a"))
    y = rows.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b"))
    fold = (
        "transform(sequence(0, {to} - 1), i -> aggregate(sequence(i, size({x}) - 1, {to}), 0L, (s, j) -> s | {x}[j]))"
    )
    width = "least(size(bits_a), size(bits_b))"
    both = (
        pairs.join(x, "a").join(y, "b")
        .withColumn("bits_a", F.expr(f"if(size(bits_a) > size(bits_b), {fold.format(x='bits_a', to=width)}, bits_a)"))
        .withColumn("bits_b", F.expr(f"if(size(bits_b) > size(bits_a), {fold.format(x='bits_b', to=width)}, bits_b)"))
    )
    missing = "aggregate(zip_with({0}, {1}, (u, v) -> bit_count(u & ~v)), 0, (s, k) -> s + k)"
    most = (
        f"least(n_a - {missing.format('bits_a', 'bits_b')}, n_b - {missing.format('bits_b', 'bits_a')})"
    )
    return both.select("a", "b", "n_a", "n_b", F.expr(most).alias("most"))


def _possible(bounded: DataFrame, bounds: _Bounds) -> DataFrame:
    """The pairs whose bound allows the overlap that their sizes ask for."""
    return bounded.where(F.expr(f"most >= {bounds.least_overlap('n_a', 'n_b')}")).select("a", "b").distinct()


def _overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The overlap of each pair over the full rows."""
    x = full.select(F.col("doc_id").alias("a"), F.col("columns").alias("x"))
    y = full.select(F.col("doc_id").alias("b"), F.col("columns").alias("y"))
    return pairs.join(y, "b").join(x, "a").select(
        "a", "b", F.size(F.array_intersect("x", "y")).alias("overlap"),
        F.size("x").alias("n_a"), F.size("y").alias("n_b"),
    )


def _distances(best: DataFrame, bounded: DataFrame, counted: DataFrame, several: DataFrame) -> DataFrame:
    """For each row and each of its two pivots the Jaccard distance between them, at least
    ``low`` and at most ``high``: exact where it was counted. Ids with several sets are
    left out, as they have no single distance."""
    share = "({0} / cast(n_a + n_b - {0} as double))"
    known = counted.select("a", "b", F.expr(f"1 - {share.format('overlap')}").alias("exact"))
    ranges = bounded.join(known, ["a", "b"], "left").select(
        "a", "b", F.expr(f"coalesce(exact, 1 - {share.format('most')})").alias("low"), F.expr("coalesce(exact, 1D)").alias("high")
    )
    pairs = best.withColumn("a", F.least("pivot", "doc_id")).withColumn("b", F.greatest("pivot", "doc_id"))
    single = pairs.join(several.select("doc_id"), "doc_id", "left_anti").join(
        several.select(F.col("doc_id").alias("pivot")), "pivot", "left_anti"
    )
    to = lambda side: F.max(F.when(F.col("side") == side, F.struct("pivot", "low", "high"))).alias(f"to{side}")
    return single.join(ranges, ["a", "b"]).groupBy("doc_id").agg(to(0), to(1))


def _too_far(side: int, bounds: _Bounds) -> str:
    """Two rows can't be linked when their distances to one pivot differ by more than a
    linked pair's own distance: the Jaccard distance obeys the triangle inequality."""
    x, y, limit = f"to{side}_a", f"to{side}_b", f"{(100 - bounds.s) / 100} + 1e-9"
    return (
        f"coalesce({x}.pivot = {y}.pivot and ({x}.low - {y}.high > {limit} or {y}.low - {x}.high > {limit}), false)"
    )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 75
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are split at white space and compared with A-Z in lower case. A text of fewer
    words than ``width`` has its whole sequence as its one n-gram; null, empty and blank
    texts have none and are linked with nothing. ``similarity`` is in percent.
    ``component_id`` is the smallest id reachable by links, the row's own included.
    Repeated rows are repeated in the result. Rows that share an id are one document,
    linked where any of its texts links. A row without an id takes part by its text: its
    component is that of rows with the same set, null if there are none. Other columns
    are not read. n-grams are held as 64-bit hashes.
    """
    spark = docs.sparkSession
    bounds = _Bounds(similarity)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(texts.mapInArrow(_describe(width), ROWS_SCHEMA))
    rows = described.where("n is not null")

    # rows with equal sets are one row of the matrix, under their smallest id
    sets = materialize(rows.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("row_id")))
    named = materialize(
        rows.select("doc_id", "n", "set_a", "set_b").join(sets, ["set_a", "set_b"], "left")
        .select("doc_id", "n", "row_id")
    )
    of_row = named.where("doc_id is not null and row_id is not null").select("doc_id", "n", "row_id").distinct()
    matrix = rows.where("n > 0").select("doc_id", "n", "bits").join(
        of_row.select(F.col("row_id").alias("doc_id"), "n").distinct(), ["doc_id", "n"], "left_semi"
    ).dropDuplicates(["doc_id", "bits"])

    common = (
        described.where("common is not null").select(F.inline("common")).groupBy("column").agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "column").limit(COMMON_COLUMNS).toPandas().sort_values(["times", "column"])
    )
    late = common["column"].to_numpy(np.int64).view(np.uint64)
    by_value = np.argsort(late)
    leading = texts.mapInArrow(
        _leading_columns(width, similarity, late[by_value], by_value), "column long, doc_id long, n int, place int"
    )

    # block product: only columns that the short block of a row holds can find a pair; the
    # other row of the pair may hold the column beyond its own short block
    short = bounds.in_short_block("n", "place")
    held = leading.groupBy("column").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(short).alias("short")
    ).where("short and first < last")
    shared = leading.join(held.select("column"), "column")
    shared = materialize(
        shared.join(of_row, ["doc_id", "n"]).groupBy("column", F.col("row_id").alias("doc_id"), "n").agg(
            F.min("place").alias("place")
        )
    )

    pivots = shared.groupBy("column").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # each row goes on with the lower and the higher pivot that it shares most columns with
    starred = shared.join(pivots, "column").select("doc_id", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("low").alias("pivot")),
        F.struct(F.lit(1).alias("side"), F.col("high").alias("pivot")),
    ))).where("pivot <> doc_id")
    overlaps = starred.groupBy("doc_id", "side", "pivot").agg(F.count("*").alias("overlap"))
    best = materialize(
        overlaps.groupBy("doc_id", "side").agg(F.max(F.struct("overlap", "pivot"))["pivot"].alias("pivot"))
    )
    tested = materialize(
        best.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
    )
    bounded = materialize(_bounded(tested, matrix))
    likely = materialize(_possible(bounded, bounds))

    def rows_of(ids: DataFrame) -> DataFrame:
        return materialize(
            texts.join(ids, "doc_id", "left_semi").mapInArrow(_full_rows(width), "doc_id long, columns array<long>")
        )

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = rows_of(ends(likely))
    counted = materialize(_overlaps(likely, full))
    links = materialize(counted.where(bounds.linked("overlap", "n_a", "n_b")).select("a", "b").distinct())
    roots = materialize(connected_components(links))

    # what is left: pairs of different components that share a column of their blocks
    several = sets.groupBy(F.col("row_id").alias("doc_id")).count().where("count > 1")
    distances = materialize(_distances(best, bounded, counted, several))
    placed = (
        shared.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(distances, "doc_id", "left")
        .select("column", "doc_id", "n", "place", F.coalesce("root", "doc_id").alias("root"), "to0", "to1")
    )
    open_columns = placed.groupBy("column").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_rows = materialize(placed.join(open_columns.select("column"), "column"))
    parts = ("doc_id", "n", "place", "root", "to0", "to1")
    x = open_rows.select("column", *(F.col(c).alias(f"{c}_a") for c in parts))
    y = open_rows.select("column", *(F.col(c).alias(f"{c}_b") for c in parts))
    smaller = F.expr("n_a < n_b or n_a = n_b and doc_id_a < doc_id_b")
    # a pair is found at its first common column in the order: none before it is shared
    room = "least(n_a - place_a, n_b - place_b)"
    found = (
        x.where(bounds.in_short_block("n_a", "place_a")).join(y, "column")
        .where(smaller & F.expr("root_a <> root_b") & bounds.sizes("n_a", "n_b"))
        .where(F.expr(f"{room} >= {bounds.least_overlap('n_a', 'n_b')}"))
        .where(F.expr(f"not ({_too_far(0, bounds)} or {_too_far(1, bounds)})"))
        .select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()
    )
    rest = materialize(_possible(_bounded(found.join(tested, ["a", "b"], "left_anti"), matrix), bounds))
    more = rows_of(ends(rest).join(full.select("doc_id"), "doc_id", "left_anti"))
    late_links = _overlaps(rest, full.union(more)).where(bounds.linked("overlap", "n_a", "n_b")).select("a", "b")
    all_roots = connected_components(links.union(late_links))

    classes = all_roots.select(F.col("node").alias("row_id"), F.col("root"))
    return named.join(classes, "row_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("root", "row_id", "doc_id").alias("component_id"),
    )
