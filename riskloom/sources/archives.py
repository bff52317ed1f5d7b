"""Tar archives of any size as files, read in ranges by many tasks.

An archive is never held in a cell. Its path travels to the tasks, which open it on the
shared file system (any that Arrow opens: mounted folders, HDFS, S3, GCS). Two passes:

* *Index.* One task an archive hops from member header to member header. That reads some
  hundred bytes a member, whatever the archive weighs, and cuts the archive into ranges
  of whole members, about ``range_bytes`` each.
* *Read.* Ranges are dealt out over all tasks. Each opens its archive, goes to the first
  of its members and streams them out one at a time.

So one archive of a terabyte keeps every executor busy. A compressed archive can only be
read from its beginning; it is one range, read as a stream without an index.
"""

from __future__ import annotations

import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.findings import FILES_SCHEMA
from riskloom.functions.scoring import repo_name

RANGE_BYTES = 256 << 20
#: A member over this has no content, as a cell can't hold it; ``read_error`` says so.
MEMBER_BYTES = 1 << 30
#: Stands for an archive that could not be read to its end.
ARCHIVE_PATH = "(archive)"
BATCH_BYTES = 32 << 20

BROKEN = (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError, KeyError, ValueError)
_COLUMNS = ["repo_id", "path", "size", "is_symlink", "content", "read_error"]
_RANGES = "repo_id string, archive string, first bigint, last bigint, plain boolean, problem string"


def shared_system(path: str) -> tuple:
    """The file system of a path that all executors see, and the path in it."""
    from pyarrow import fs

    # Hadoop writes file:/a for file:///a
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else path)


def open_shared(path: str):
    """A binary file for reading and seeking."""
    system, inside = shared_system(path)
    return system.open_input_file(inside)


def member_path(member: tarfile.TarInfo) -> str:
    return member.name.removeprefix("./")


def linked_content(archive: str, target: str) -> bytes:
    """The content of the member that a hard link names, looked for from the beginning:
    it may lie in another range."""
    with open_shared(archive) as stream, tarfile.open(fileobj=stream, mode="r:*") as tar:
        while (member := tar.next()) is not None:
            if member.isfile() and member.name == target:
                return tar.extractfile(member).read()
            tar.members.clear()
    raise KeyError(f"linkname {target!r} not found")


def file_row(repo_id: str, archive: str, member: tarfile.TarInfo, tar: tarfile.TarFile) -> tuple | None:
    """A member as a row of ``files``; folders have none. A hard link has the content of
    what it names, a symbolic link none."""
    path = member_path(member)
    if member.issym():
        return repo_id, path, 0, True, None, None
    if not (member.isfile() or member.islnk()):
        return None
    if member.size > MEMBER_BYTES:
        return repo_id, path, member.size, False, None, f"larger than {MEMBER_BYTES} bytes"
    if member.islnk():
        try:
            content = linked_content(archive, member.linkname)
        except KeyError as lost:
            return repo_id, path, 0, False, None, str(lost.args[0])
        return repo_id, path, len(content), False, content, None
    return repo_id, path, member.size, False, tar.extractfile(member).read(), None


def _is_plain(stream) -> bool:
    """Whether a tar is uncompressed: its first block is a header (or the end)."""
    block = stream.read(tarfile.BLOCKSIZE)
    stream.seek(0)
    try:
        tarfile.TarInfo.frombuf(block, tarfile.ENCODING, "surrogateescape")
    except tarfile.EOFHeaderError:
        return True
    except tarfile.HeaderError:
        return False
    return True


def ranges_of(stream, range_bytes: int) -> Iterator[tuple[int, int, str | None]]:
    """``first, last`` (offsets of the first and behind the last member) of ranges of
    members, and what ended an archive that breaks off, with the range before it."""
    first = now = 0
    problem = None
    try:
        with tarfile.open(fileobj=stream, mode="r:") as tar:
            size = stream.size()
            while (member := tar.next()) is not None:
                tar.members.clear()  # an index of millions of members would outgrow the task
                now = tar.offset
                if now > size:  # the reader finds the cut member
                    break
                if now - first >= range_bytes:
                    yield first, now, None
                    first = now
        stream.seek(min(now, size))
        if any(stream.read(tarfile.BLOCKSIZE)):
            problem = "invalid header"
    except BROKEN as broken:
        problem = str(broken)
    if now > first or problem:
        yield first, now, problem


def members_between(stream, first: int, last: int) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """The members of a range, which begins at a header."""
    stream.seek(first)
    with tarfile.open(fileobj=stream, mode="r:") as tar:
        while (member := tar.next()) is not None and member.offset < last:
            yield tar, member
            tar.members.clear()


def members_streamed(stream) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """The members of a compressed archive, in order."""
    with tarfile.open(fileobj=stream, mode="r:*") as tar:
        while (member := tar.next()) is not None:
            yield tar, member
            tar.members.clear()


def _index(range_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo_id, archive in zip(batch["repo_id"], batch["archive"], strict=True):
                rows = []
                try:
                    with open_shared(archive) as stream:
                        if not _is_plain(stream):
                            rows.append((repo_id, archive, 0, None, False, None))
                        else:
                            for first, last, problem in ranges_of(stream, range_bytes):
                                rows.append((repo_id, archive, first, last, True, problem))
                except BROKEN as problem:
                    rows.append((repo_id, archive, 0, 0, True, str(problem)))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in _RANGES.split(", ")])
                yield out.astype({"first": "Int64", "last": "Int64"})

    return run


def _rows(repo_id: str, archive: str, first: int, last: int | None, plain: bool, problem: str | None) -> Iterator[tuple]:
    """The files of one range; an archive that breaks off ends with a row that says so."""
    try:
        with open_shared(archive) as stream:
            members = members_between(stream, first, last) if plain and last > first else () if plain else members_streamed(stream)
            for tar, member in members:
                row = file_row(repo_id, archive, member, tar)
                if row is not None:
                    yield row
    except BROKEN as broken:
        problem = problem or str(broken)
    if problem:
        yield repo_id, ARCHIVE_PATH, 0, False, None, problem


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            last = None if pd.isna(r.last) else int(r.last)
            for row in _rows(r.repo_id, r.archive, int(r.first), last, bool(r.plain), r.problem):
                rows.append(row)
                held += 200 + len(row[4] or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``repo_id, archive``: the archives below a path, listed by Spark without a look
    into them. ``repo_id`` is the archive's name without its extension."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return listed.select(
        F.regexp_replace(repo_name(F.col("path")), r"\.(tar(\.\w+)?|tgz)$", "").alias("repo_id"),
        F.col("path").alias("archive"),
    )


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``files`` (with ``read_error``) of all tars below a path, plain or compressed, one
    repository each.

    Folders have no row. A symbolic link is a row without content, a hard link has the
    content of the member it names. A member over ``MEMBER_BYTES`` has its size and an
    error, no content. An archive that breaks off, or is none, gives what came before and
    a row ``(archive)`` with the error. An archive without members, or a file of no bytes
    (which Spark does not list), gives nothing.
    """
    wide = spark.sparkContext.defaultParallelism
    ranges = (
        list_archives(spark, path).repartition(wide, "archive")
        .mapInPandas(_index(range_bytes), _RANGES)
        .repartition(4 * wide, "archive", "first")
    )
    return ranges.mapInPandas(_read, f"{FILES_SCHEMA}, read_error string")
