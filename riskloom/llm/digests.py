"""Exact dedup as a tree merge of sorted digest runs.

Each document becomes one entry: a digest of its normalised text, and the claim of its
row to stay. The entries of an input partition form a *run*, sorted by digest, in which
equal digests are one entry: their number and the best claim. Runs are merged in rounds
as in a binomial tree, ``FAN_IN`` runs at a time: in each round the runs whose numbers
agree but for their last digit exchange entries, so that equal digests meet, and merge
into one sorted run. The last round leaves one run, which lies in digest ranges over all
tasks: no task and no driver ever holds a run whole.

A digest that a third of all rows share is one entry a run in every round, so no round
has more than ``FAN_IN`` entries of it in one place. An entry is 128 bits of two hashes,
the length of the text and its SHA-256; entries merge only when all of these agree, which
is the verification that goes with each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.storage import materialize

FAN_IN = 16
_KEY = ["digest", "length", "check"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``doc_id, n_chars, digest, length, check, run``."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("n_chars"),
        normalised(F.col(text_col)).alias("plain"),
        F.spark_partition_id().alias("run"),
    )
    return texts.select(
        "doc_id", "n_chars", F.sha2("plain", 256).alias("digest"),
        F.char_length("plain").alias("length"), F.xxhash64("plain").alias("check"), "run",
    )


def _claim() -> Column:
    """Orders rows by who stays: most code points, then smallest id, rows without an id last."""
    return F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id")


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of one number become one: equal digests are one entry."""
    return runs.groupBy("run", *_KEY).agg(
        F.min("claim").alias("claim"), F.sum("n_rows").alias("n_rows")
    ).sortWithinPartitions("run", "digest")


def merge_runs(entries: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """``digest, length, check, keep_id, keep_chars, group_size`` for each different text."""
    runs = _merged(entries.select("run", *_KEY, _claim().alias("claim"), F.lit(1).cast("long").alias("n_rows")))
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        runs = _merged(materialize(runs).withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
    return runs.select(
        *_KEY, F.col("claim.doc_id").alias("keep_id"), (-F.col("claim.fewer")).alias("keep_chars"),
        F.col("n_rows").alias("group_size"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every document.

    Texts are equal when they agree without white space; null is empty. Of equal texts
    the row with the most code points stays, then the one of smallest id, and
    ``group_size`` counts their rows. Rows repeated whole (equal id and text) count each
    in ``group_size`` but give one row, so that exactly one row of a group stays; texts
    of one id that differ give a row each. Rows without an id stay only where no row of
    their group has one as long. Other columns are not read. An empty table gives none.
    """
    entries = materialize(digest_entries(docs, id_col, text_col))
    n_runs = (entries.agg(F.max("run")).first()[0] or 0) + 1
    groups = materialize(merge_runs(entries, n_runs, fan_in))
    rows = entries.groupBy("doc_id", *_KEY).agg(F.max("n_chars").alias("n_chars"))
    return rows.join(groups, _KEY).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group.

    Of rows that agree in id and normalised text one with the most code points stays.
    """
    stays = exact_groups(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.sha2(normalised(F.col(text_col)), 256).alias("_digest"),
        F.struct(
            F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("length"),
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        ).alias("_row"),
    )
    same = rows["_id"].eqNullSafe(stays["_id"]) & (rows["_digest"] == stays["_digest"])
    kept = rows.join(stays, same, "left_semi")
    once = kept.groupBy("_id", "_digest").agg(F.max_by("_row.row", "_row.length").alias("_row"))
    return once.select("_row.*")
