"""Tables kept for later steps of the same job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in
    ``spark.checkpoint.dir``. A local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="riskloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside gives its shuffle files back as soon as it has ended. A write
    is never read again through them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: For rows of megabytes: a row group is held in memory as a whole when it is written, and
#: decoded as a whole when it is read, and by default it has a hundred rows at least.
WIDE_ROWS = {
    "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1",
}


def store(df: DataFrame, **options: str) -> str:
    """Write the rows as Parquet to a new place in the shared folder, which is returned.
    ``options`` are those of the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.options(**options).parquet(path)
    return path


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Store the rows and read them back: computed once, used by several steps,
    column-pruned on reading, and safe when executors are lost. ``options``: see ``store``."""
    path = store(df, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)
