"""First k rows per group, safe for a group that holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def top_k(
    df: DataFrame, group: list[str], order: list[Column], k: int,
    spread_by: list[str], rank: str = "rank", salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows of each group by ``order`` (which must be total), ranked.

    Groups are cut into salts first, each salt keeps its own first k, and the second
    window sees at most ``salts * k`` rows per group. Both windows become a group limit
    that also runs before the shuffle.
    """
    salted = df.withColumn(
        "__salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts))
    )
    partial = Window.partitionBy(*group, "__salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("__rank", F.row_number().over(partial))
        .filter(F.col("__rank") <= k)
        .drop("__salt", "__rank")
        .withColumn(rank, F.row_number().over(final))
        .filter(F.col(rank) <= k)
    )
