"""Which files of a repository are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.globs import any_glob_regex
from riskloom.functions.text import (
    SPACE, decode_utf8, file_name, file_suffix, universal_newlines,
)
from riskloom.operators.joins import join_measured
from riskloom.operators.topk import top_k
from riskloom.storage import materialize


def in_skipped_dir(path: Column) -> Column:
    """Any directory below the repository root carries a skipped name."""
    parts = F.split(path, "/")
    return F.arrays_overlap(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, rules.SKIP_DIRS))
    )


def skipped_extension(path: Column) -> Column:
    return F.lower(file_suffix(path)).isin(rules.SKIP_EXTENSIONS)


def skipped_name(path: Column) -> Column:
    name = file_name(path)
    skipped = name.isin(rules.SKIP_NAMES)
    for suffix in rules.SKIP_NAME_SUFFIXES:
        skipped = skipped | name.endswith(suffix)
    return skipped


def wanted(mode: str = "balanced", quick_bytes: int = rules.QUICK_MAX_BYTES) -> Column:
    """Path, link and size filters over the ``files`` columns. Only ``quick`` differs: it
    leaves out files of more than ``quick_bytes``."""
    if mode not in rules.SCAN_MODES:
        raise ValueError(f"unknown scan mode {mode!r}, use one of {', '.join(rules.SCAN_MODES)}")
    path = F.col("path")
    keep = (
        ~F.coalesce(F.col("is_symlink"), F.lit(False))
        & ~in_skipped_dir(path) & ~skipped_extension(path) & ~skipped_name(path)
        & F.col("size").isNotNull()
    )
    return keep & (F.col("size") <= quick_bytes) if mode == "quick" else keep


def ignore_globs(content: Column) -> Column:
    """Globs of an ignore file: lines stripped, blanks and comments dropped. A comment
    is a line that *starts* with ``#`` before stripping."""
    line_end = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
    lines = F.split(universal_newlines(decode_utf8(content)), line_end)
    kept = F.filter(lines, lambda line: ~line.startswith("#"))
    edges = rf"(?U)^{SPACE}++|(?<!{SPACE}){SPACE}++$"
    stripped = F.transform(kept, lambda line: F.regexp_replace(line, edges, ""))
    return F.filter(stripped, lambda line: line != "")


def ignore_lists(files: DataFrame) -> DataFrame:
    """``(repo_id, globs)``: one row per repository with a root ignore file. In a table of
    ``store_files`` only the partition of such files is read."""
    listed = files.filter("control") if "control" in files.columns else files
    return (
        listed.filter((F.col("path") == rules.IGNORE_FILE) & ~F.coalesce(F.col("is_symlink"), F.lit(False)))
        .select("repo_id", ignore_globs(F.col("content")).alias("globs"))
    )


def ignore_rules(lists: DataFrame) -> DataFrame:
    """``(repo_id, ignore_regex)``: all globs of a repository as one regex."""
    return lists.select("repo_id", any_glob_regex(F.col("globs")).alias("ignore_regex"))


def mark_ignored(files: DataFrame, rules_by_repo: DataFrame, column: str = "ignored") -> DataFrame:
    """Adds a flag: the repository's globs match the relative path or the name."""
    joined = join_measured(files, rules_by_repo, ["repo_id"], "left", spread_by=["path"])
    pattern = F.col("ignore_regex")
    # unlike rlike, this keeps the compiled pattern from row to row of a repository
    hit = (F.regexp_instr("path", pattern) > 0) | (
        F.regexp_instr(file_name(F.col("path")), pattern) > 0
    )
    return joined.withColumn(column, F.coalesce(hit, F.lit(False))).drop("ignore_regex")


def mark_beyond_cap(
    files: DataFrame, candidates: DataFrame, limit: int = rules.QUICK_MAX_FILES,
    column: str = "beyond_cap",
) -> DataFrame:
    """Adds a flag to files after a repository's first ``limit`` candidates by path.

    Only ``(repo_id, path)`` is ranked. What comes back is one path per repository
    that reaches the limit, so file contents are neither sorted nor shuffled for it.
    """
    ranked = top_k(
        candidates.select("repo_id", "path"), ["repo_id"], [F.col("path")], limit,
        spread_by=["path"],
    )
    last = materialize(
        ranked.filter(F.col("rank") == limit).select("repo_id", F.col("path").alias("last_path"))
    )
    joined = join_measured(files, last, ["repo_id"], "left", spread_by=["path"])
    beyond = F.col("last_path").isNotNull() & (F.col("path") > F.col("last_path"))
    return joined.withColumn(column, beyond).drop("last_path")


def select_files(
    files: DataFrame, mode: str = "balanced", quick_bytes: int = rules.QUICK_MAX_BYTES,
    quick_files: int = rules.QUICK_MAX_FILES,
) -> DataFrame:
    """``files`` plus ``selected``: does the scan of this mode read the file?

    The ignore rules are stored once; measuring, joining and ranking read that small
    table and the listing, never contents."""
    marked = mark_ignored(files, materialize(ignore_rules(ignore_lists(files))))
    marked = marked.withColumn("selected", wanted(mode, quick_bytes) & ~F.col("ignored")).drop("ignored")
    if mode != "quick":
        return marked
    capped = mark_beyond_cap(marked, marked.filter("selected"), quick_files)
    return capped.withColumn("selected", F.col("selected") & ~F.col("beyond_cap")).drop("beyond_cap")
