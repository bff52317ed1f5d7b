"""From raw documents to a training mix, one operator a stage.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept,
and returns a table. It is written as Parquet to the shared folder and read again as the
next stage's ``docs``. All stages but the last return the columns of ``docs``.

Null texts count as empty and stay until a rule drops them: an empty text isn't toxic,
equals all other empty texts, is linked with nothing, holds no benchmark passage, and has
no token, so it can be in the mix. Rows without an id pass the stages that judge a row by
its text alone, and drop out where documents are told apart by id (near duplicates, and
decontamination). Extra columns are carried along. Rows that repeat an id and a text whole
become one row in the second stage. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.digests import keep_one
from riskloom.llm.jaccard import jaccard_components
from riskloom.llm.positional import contamination, phrase_matches
from riskloom.llm.queries import mixed
from riskloom.llm.toxicity import toxicity_scores
from riskloom.session import configure
from riskloom.storage import materialize


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``."""
    return docs.join(ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "doc_id", "left_semi")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score holds for toxic go."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity_scores(docs, labels, threshold=0.3)
    toxic = scores.where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays."""
    configure(spark)
    return keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one of smallest id stays."""
    configure(spark)
    groups = jaccard_components(docs, width=5, similarity=75)
    return _only(docs, groups.where("doc_id = component_id")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    benchmark = configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    figures = contamination(phrase_matches(docs, benchmark, window=13), percent=5)
    return _only(docs, figures.where("not contaminated")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the training mix."""
    configure(spark)
    return mixed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The first stage is a fitted score, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
