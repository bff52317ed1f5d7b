"""Files from repository snapshots: directory trees, and small archives held in cells
(``riskloom.sources.archives`` reads archives of any size).

Spark's own binary reader must not be pointed at a raw tree: it leaves out names that
start with ``.`` or ``_`` and follows symbolic links.
"""

from __future__ import annotations

import io
import lzma
import os
import tarfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from riskloom import rules
from riskloom.functions.findings import FILES_SCHEMA
from riskloom.sources.archives import ARCHIVE_PATH, BATCH_BYTES

_COLUMNS = ["repo_id", "path", "size", "is_symlink", "content"]


def _batches(records: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Bounded output batches, however many members one archive holds."""
    rows, held = [], 0
    for record in records:
        rows.append(record)
        held += 200 + len(record[4] or b"")
        if held >= BATCH_BYTES:
            yield pd.DataFrame(rows, columns=columns)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _members(repo_id: str, archive: bytes | None) -> Iterator[tuple]:
    """The files of one archive. One that breaks off, or is none, gives what came before
    and a row that says so."""
    try:
        with tarfile.open(fileobj=io.BytesIO(archive or b""), mode="r:*") as tar:
            for member in tar:
                if member.isdir():
                    continue
                path = member.name.removeprefix("./")
                if member.issym():
                    yield repo_id, path, 0, True, None, None
                elif member.isfile() or member.islnk():
                    handle = tar.extractfile(member)
                    yield repo_id, path, member.size, False, handle.read() if handle else None, None
    except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError, KeyError) as problem:
        yield repo_id, ARCHIVE_PATH, 0, False, None, str(problem)


def expand_archives(archives: DataFrame) -> DataFrame:
    """``files`` (with ``read_error``) from a table ``repo_id, content`` of tars."""

    def expand(batches):
        for batch in batches:
            for repo_id, content in zip(batch["repo_id"], batch["content"], strict=True):
                yield from _batches(_members(repo_id, content), [*_COLUMNS, "read_error"])

    return archives.select("repo_id", "content").mapInPandas(expand, FILES_SCHEMA + ", read_error string")


def _walk(repo_id: str, root: str) -> Iterator[tuple]:
    for folder, subfolders, names in os.walk(root):
        subfolders[:] = [d for d in subfolders if d not in rules.SKIP_DIRS]
        for name in names:
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root).replace(os.sep, "/")
            link = os.path.islink(full)
            try:
                size = 0 if link else os.stat(full).st_size
            except OSError:
                continue
            yield repo_id, root, path, size, link


def read_trees(spark: SparkSession, roots: list[str], partitions: int | None = None) -> DataFrame:
    """Directory trees on a file system that all executors mount, one repository each.

    Trees are listed in parallel; the listing (no contents) is then spread by path, so
    that reading one huge tree uses every executor. ``read_error`` says why a listed
    file could not be read.
    """
    named = [(os.path.basename(os.path.abspath(r)).removesuffix(".git"), os.path.abspath(r)) for r in roots]
    listing_columns = ["repo_id", "root", "path", "size", "is_symlink"]

    def list_trees(batches):
        for batch in batches:
            for repo_id, root in zip(batch["repo_id"], batch["root"]):
                rows = []
                for row in _walk(repo_id, root):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=listing_columns)
                        rows = []
                yield pd.DataFrame(rows, columns=listing_columns)

    def read(record) -> tuple:
        content, error = None, None
        if not record.is_symlink:
            try:
                with open(os.path.join(record.root, record.path), "rb") as handle:
                    content = handle.read()
            except OSError as problem:
                error = problem.strerror
        return record.repo_id, record.path, record.size, record.is_symlink, content, error

    def read_contents(batches):
        for batch in batches:
            yield from _batches(map(read, batch.itertuples()), [*_COLUMNS, "read_error"])

    parallelism = partitions or spark.sparkContext.defaultParallelism
    listing = (
        spark.createDataFrame(named, "repo_id string, root string")
        .repartition(min(len(named), parallelism))
        .mapInPandas(list_trees, "repo_id string, root string, path string, size bigint, is_symlink boolean")
        .repartition(parallelism, "repo_id", "path")
    )
    return listing.mapInPandas(read_contents, FILES_SCHEMA + ", read_error string")
