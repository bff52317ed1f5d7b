"""Huge files as chunks of whole lines.

A chunk ends behind a line end that no match can cross, so every match lies whole in one
chunk and no overlap is needed. Matches cross a line end only within the blanks around
the ``=`` or ``:`` of an assignment: what comes next is then ``:``, ``=``, a quote, or
anything if a ``=`` came before. A cut is made where neither is so.

Cuts depend on the bytes behind an offset only, so any task can find those of its own
range of a file: chunk ``k`` goes from the first cut behind ``k * chunk_bytes`` to the
first one behind ``(k + 1) * chunk_bytes``. Files that have to be seen whole are one chunk:
UTF-16, and container build files, whose stages refer to each other. A stretch without
such a line end (a line of any length) stays in one chunk too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskloom import rules
from riskloom.sources import archives

CHUNK_BYTES = 64 << 20
BLOCK = 1 << 20
#: A character cut by the end of the binary test's bytes is judged by up to three more.
HEAD_BYTES = rules.BINARY_PROBE_BYTES + 3
CHUNKS_SCHEMA = (
    "repo_id string, path string, size bigint, is_symlink boolean, chunk bigint, head binary, content binary"
)
_BLANK = rb"\t-\r\x1c- "
_GAP = re.compile(rb"[!-<>-~]([" + _BLANK + rb"]++)(?=[!#-&(-9;<>-~])")
_MARKS = (b"\xff\xfe", b"\xfe\xff")

Reader = Callable[[int, int], bytes]


def must_stay_whole(path: str, head: bytes) -> bool:
    name = path.rsplit("/", 1)[-1]
    return head.startswith(_MARKS) or name == "Dockerfile" or name.startswith("Dockerfile.") or name.endswith(".dockerfile")


def next_cut(read: Reader, size: int, offset: int, block: int = BLOCK) -> int:
    """The first place to cut behind ``offset``; the end of the file if there is none.
    ``read(first, n)`` gives up to n bytes from ``first`` on."""
    held, at = b"", min(offset, size)
    while at < size:
        more = read(at + len(held), block)
        held += more
        for gap in _GAP.finditer(held):
            last = held.rfind(b"\n", gap.start(1), gap.end(1))
            if last >= 0:
                return at + last + 1
        if not more:
            break
        # all that may still begin a match is the last sign before the blanks at the end
        rest = max(len(held.rstrip(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")) - 1, 0)
        at, held = at + rest, held[rest:]
    return size


def chunk_of(read: Reader, path: str, size: int, k: int, chunk_bytes: int) -> tuple[int, int, bytes] | None:
    """``first, last, head`` of chunk ``k`` of a file, None if nothing falls to it."""
    head = read(0, HEAD_BYTES)
    if must_stay_whole(path, head):
        return (0, size, head) if k == 0 else None
    first = 0 if k == 0 else next_cut(read, size, k * chunk_bytes)
    last = next_cut(read, size, (k + 1) * chunk_bytes)
    return (first, last, head) if first < last or k == 0 else None


def n_chunks(size: int, chunk_bytes: int) -> int:
    return max(-(-size // chunk_bytes), 1)


def cut_files(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``files`` whose content is in a cell already, as chunks. Without a content a file is
    one chunk without one."""
    schema = to_arrow_schema(StructType.fromDDL(CHUNKS_SCHEMA))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                content = row.pop("content")
                if content is None:
                    rows.append(row | {"chunk": 0, "head": None, "content": None})
                    continue
                read = lambda first, n, data=content: data[first:first + n]
                for k in range(n_chunks(len(content), chunk_bytes)):
                    if found := chunk_of(read, row["path"], len(content), k, chunk_bytes):
                        first, last, head = found
                        rows.append(row | {"chunk": k, "head": head, "content": content[first:last]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    columns = ["repo_id", "path", "size", "is_symlink", "content"]
    return files.select(columns).mapInArrow(cut, CHUNKS_SCHEMA)


_PLACES = "repo_id string, archive string, path string, size bigint, place bigint"


def _large_members(over: int):
    """Where the members over a size begin: headers are read, contents hopped over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = []
                try:
                    with archives.open_shared(r.archive) as stream:
                        if archives._is_plain(stream):
                            for _, member in archives.members_between(stream, 0, stream.size()):
                                whole = member.offset_data + member.size <= stream.size()
                                if member.isfile() and not member.issparse() and member.size > over and whole:
                                    found.append((r.repo_id, r.archive, archives.member_path(member), member.size, member.offset_data))
                except archives.BROKEN:
                    pass  # read_archives says what broke; members before it are whole
                yield pd.DataFrame(found, columns=[c.split()[0] for c in _PLACES.split(", ")])

    return run


def _read_chunks(chunk_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHUNKS_SCHEMA.split(", ")]
        for batch in batches:
            for r in batch.itertuples(index=False):
                with archives.open_shared(r.archive) as stream:
                    def read(first: int, n: int, place=int(r.place), size=int(r.size)) -> bytes:
                        stream.seek(place + first)
                        return stream.read(max(min(n, size - first), 0))

                    found = chunk_of(read, r.path, int(r.size), int(r.chunk), chunk_bytes)
                    if found:
                        first, last, head = found
                        row = r.repo_id, r.path, r.size, False, r.chunk, head, read(first, last - first)
                        yield pd.DataFrame([row], columns=columns)

    return run


def read_large_members(
    spark: SparkSession, path: str, over: int = archives.MEMBER_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Chunks of the members over a size in the uncompressed tars below a path: those that
    ``read_archives`` gives without their content. Chunks of one member are read by many
    tasks, each of which goes to its place in the archive."""
    wide = spark.sparkContext.defaultParallelism
    places = archives.list_archives(spark, path).repartition(wide, "archive").mapInPandas(_large_members(over), _PLACES)
    n = F.greatest(F.ceil(F.col("size") / chunk_bytes), F.lit(1)).cast("bigint")
    todo = places.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk"))
    return todo.repartition(4 * wide, "archive", "path", "chunk").mapInPandas(_read_chunks(chunk_bytes), CHUNKS_SCHEMA)
