"""Joining a big table with one that is usually small but may grow with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def measured_bytes(df: DataFrame) -> int:
    """Size of a table as text: one aggregate over its own rows."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"]
    return int(size or 0)


def join_measured(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    spread_by: list[str],
    residual: Column | None = None,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join on equal ``on`` columns (and ``residual``, over both sides' columns).

    The small side is broadcast only if its measured size allows it. Otherwise both
    sides are shuffled on the key plus a salt: the big side's rows of one key are
    spread by a hash of ``spread_by``, the small side's rows are repeated per salt, so
    a key holding a third of all rows still feeds many tasks.
    """
    keys = list(on)
    renamed = small.select(*[
        F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in small.columns
    ])
    extra: list[str] = [f"__{c}" for c in keys]
    condition = F.lit(True)
    for c in keys:
        condition = condition & (F.col(c) == F.col(f"__{c}"))
    if residual is not None:
        condition = condition & residual
    if measured_bytes(small) <= max_bytes:
        joined = big.join(F.broadcast(renamed), condition, how)
    else:
        salted = big.withColumn(
            "__salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
        )
        repeated = renamed.withColumn(
            "__small_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        )
        joined = salted.join(
            repeated, condition & (F.col("__salt") == F.col("__small_salt")), how
        )
        extra += ["__salt", "__small_salt"]
    return joined.drop(*extra)
