"""Extension: the file detectors hold no state, so the same pass runs on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions import scoring as S
from riskloom.functions.findings import FILES_SCHEMA, is_caution
from riskloom.operators.paths import wanted
from riskloom.plans.scan import analyze
from riskloom.plans.summary import rollup

#: Files that may arrive again say which arrival it is; the greatest counts.
VERSIONED_SCHEMA = f"{FILES_SCHEMA}, version bigint"
CHANGES_SCHEMA = "repo_id string, risk_score double, files bigint, findings bigint, cautions bigint"
_STATE = (
    "repos array<string>, paths array<string>, versions array<bigint>, risk_scores array<double>, "
    "findings array<bigint>, cautions array<bigint>"
)
#: Files share their state by groups, as a call of Python for each file costs more than all else.
GROUPS = 1 << 13


def read_arrivals(spark: SparkSession, path: str, schema: str = FILES_SCHEMA) -> DataFrame:
    """Parquet files of ``files`` rows, picked up as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def scan_arrivals(files: DataFrame, mode: str = "balanced") -> DataFrame:
    """One result per arriving file that passes the path filters, with its ``version`` if
    files have one."""
    keep = ["version"] if "version" in files.columns else None
    return analyze(files.filter(wanted(mode)), keep=keep)


def _replace(key: tuple, arrivals: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the arrivals of a group of files change in their repositories: the result of a
    file that held so far is taken out, the newest comes in."""
    held = {}
    if state.exists:
        repos, paths, *numbers = state.get
        held = dict(zip(zip(repos, paths), zip(*numbers)))
    newest = {}
    for batch in arrivals:
        columns = (batch[c].tolist() for c in ("repo_id", "path", "version", "risk_score", "findings", "cautions"))
        for repo_id, path, *seen in zip(*columns):
            file, seen = (repo_id, path), tuple(seen)
            newest[file] = max(newest.get(file) or held.get(file) or seen, seen)
    changed = {file: now for file, now in newest.items() if now != held.get(file)}
    if changed:
        rows = [(file[0], was[1], -1, -was[2], -was[3]) for file in changed if (was := held.get(file))]
        rows += [(file[0], now[1], 1, now[2], now[3]) for file, now in changed.items()]
        held |= changed
        state.update(tuple(map(list, zip(*((*file, *now) for file, now in held.items())))))
        yield pd.DataFrame(rows, columns=["repo_id", "risk_score", "files", "findings", "cautions"])


def result_changes(results: DataFrame, groups: int = GROUPS) -> DataFrame:
    """The changes (``CHANGES_SCHEMA``) that results with a ``version`` make: adding up all
    of them gives the state of each repository, with every file counted once, by its
    greatest version. An arrival of a smaller version changes nothing; of equal versions
    the higher score counts. Rows without a version, repository or path are left out.

    State is four numbers a file and its name. It is keyed by ``groups`` hashes of files, so
    a repository with a third of all files is spread like any other, and a batch calls Python
    once a group that has arrivals. A group is read and written as a whole: many times
    the files ask for more groups. A checkpoint holds for one number of groups."""
    cautions = F.size(F.filter("findings", lambda f: is_caution(f["severity"])))
    numbers = results.where("version is not null and repo_id is not null and path is not null").select(
        "repo_id", "path", "version", "risk_score",
        (F.size("findings") - cautions).cast("bigint").alias("findings"), cautions.cast("bigint").alias("cautions"),
        F.pmod(F.xxhash64("repo_id", "path"), F.lit(groups)).alias("file_group"),
    )
    return numbers.groupBy("file_group").applyInPandasWithState(
        _replace, CHANGES_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def rollup_changes(changes: DataFrame) -> DataFrame:
    """The columns of ``rollup`` from all changes so far. Scores are whole numbers up to
    100, so what is left of a repository are at most 101 rows."""
    per_score = changes.groupBy("repo_id", "risk_score").agg(
        F.sum("files").alias("files"), F.sum("findings").alias("findings"), F.sum("cautions").alias("cautions")
    ).where("files > 0")
    level = S.band(F.col("risk_score"))
    files = lambda *bands: F.coalesce(F.sum(F.when(level.isin(*bands), F.col("files"))), F.lit(0).cast("bigint"))
    return per_score.groupBy("repo_id").agg(
        F.sum("files").alias("total_files"), F.max("risk_score").alias("overall_risk_score"),
        files("critical", "high").alias("high_risk_files"), files("medium").alias("medium_risk_files"),
        files("low").alias("low_risk_files"), files("safe").alias("safe_files"),
        F.sum("findings").alias("findings_count"), F.sum("cautions").alias("cautions_count"),
    ).withColumn("risk_level", S.band(F.col("overall_risk_score")))


def write_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results to a table, exactly once per file."""
    return (
        results.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def write_rollups(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts and score per repository and batch. They are partial sums and maxima:
    adding (or taking the maximum of) the batches gives the whole. A retried batch
    overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rollup(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
