"""Which points lie in which half-open intervals, as sorting, counting and equal keys.

A join on a range compares every point of a key with every interval of it. Here points and
bounds are sorted together once; a bound's place among the points is a running count, so
an interval is a run of point numbers. Numbers then meet on equality. The work is that of
the sort and of the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.storage import materialize


def _numbered(points: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, at, is_point, before``: the points of the key below ``at``, for each
    distinct point and bound. The sort is by ranges of key *and* place, so a key with a
    third of all points is spread over many tasks; a range adds the counts of the ranges
    before it."""
    rows = points.select(*keys, "at", F.lit(1).alias("is_point")).union(
        bounds.select(*keys, "at", F.lit(0).alias("is_point"))
    )
    wide = points.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # stored, so that each row stays in the range it was counted in
    sorted_ = materialize(
        rows.repartitionByRange(int(wide), *keys, "at").withColumn("range", F.spark_partition_id())
    )
    in_range = Window.partitionBy("range", *keys).orderBy("at", "is_point").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy(*keys, "range").agg(F.sum("is_point").alias("n"))
    offsets = counts.select(*keys, "range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("offset"))
    local = sorted_.withColumn("local", F.coalesce(F.sum("is_point").over(in_range), F.lit(0)))
    return local.join(offsets, [*keys, "range"]).select(
        *keys, "at", "is_point", (F.col("local") + F.col("offset")).alias("before")
    )


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """All pairs of a row of ``points`` and a row of ``intervals`` that agree in ``keys``
    and have ``low <= point < high``; a null bound is open. ``points`` are distinct in
    keys and point, which are not null; rows of ``intervals`` may repeat. Result: columns
    of ``intervals`` but the bounds, and ``point``."""
    places = points.select(*keys, F.col(point).alias("at"))
    bounds = intervals.select(*keys, F.explode(F.array(low, high)).alias("at")).where("at is not null").distinct()
    numbered = materialize(_numbered(places, bounds, keys))
    totals = places.groupBy(*keys).agg(F.count("*").alias("_total"))
    found = intervals.join(totals, keys)
    for bound, name, open_ in ((low, "_from", F.lit(0)), (high, "_to", F.col("_total"))):
        place = numbered.where("is_point = 0").select(*keys, F.col("at").alias(bound), F.col("before").alias(name))
        found = found.join(place, [*keys, bound], "left").withColumn(name, F.coalesce(F.col(name), open_))
    runs = found.where("_from < _to").withColumn("_number", F.explode(_run(F.col("_from"), F.col("_to"))))
    named = numbered.where("is_point = 1").select(*keys, F.col("before").alias("_number"), F.col("at").alias(point))
    return runs.join(named, [*keys, "_number"]).drop("_number", "_from", "_to", "_total", low, high)


def _run(first: Column, last: Column) -> Column:
    return F.sequence(first, last - 1)
