"""Token counts: the exact histogram of encoded lengths, and suffix sums over it.

Each document is encoded whole with a public tokenizer, whose file is a parameter, and
only its length leaves the task. Documents are aggregated by length; the histogram has a
row for each length that occurs. Sums over all longer documents then answer, for any
context limit, how many documents and tokens are within it, what truncation leaves, and
any quantile, without another look at a text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The pattern that cuts a text into the parts that the byte-pair tokenizers of this
#: family encode one by one (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths in a block of the suffix sums.
BLOCK = 256

_encodings: dict[int, object] = {}


def _encoding(ranks: bytes, pattern: str):
    """The encoder, made once a worker."""
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _encodings:
        lines = (line.split() for line in ranks.splitlines() if line)
        _encodings[key] = tiktoken.Encoding(
            "corpus", pat_str=pattern, special_tokens={},
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in lines},
        )
    return _encodings[key]


def token_counter(spark: SparkSession, path: str = TOKENIZER, pattern: str = PATTERN):
    """A function for ``mapInArrow`` from texts to numbers of tokens. The vocabulary, of
    some hundred kilobytes, is read here and broadcast: executors need no copy of it."""
    with open(path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(text.as_py() or "")) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return run


def length_histogram(docs: DataFrame, counter, text_col: str = "text") -> DataFrame:
    """``n_tokens, n_docs`` for each length that occurs; null texts have no token.

    Every row counts, also repeated ones; other columns are not read. An empty table
    gives an empty histogram."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(counter, "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs: ``docs_at_least`` and ``tokens_at_least`` of documents
    that long or longer, ``docs_at_most``, ``tokens_at_most``, ``truncated_tokens`` (all
    documents cut to this length) and ``quantile`` (the share of documents this long at
    most). Sums run inside blocks of lengths, then over the blocks, so no window sees more
    than ``BLOCK`` lengths, or one row a block."""
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "block", F.floor(F.col("n_tokens") / BLOCK)
    )
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    over = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = sums.select(
        "block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("all_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", "docs", "all_tokens", "tokens",
        (F.col("docs_after") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_after") + F.sum("tokens").over(inside)).alias("tokens_at_least"),
    )
    below = F.col("all_tokens") - F.col("tokens_at_least")
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (below + F.col("tokens")).alias("tokens_at_most"),
        (below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For any context limits, also between lengths that occur: ``context_limit, docs,
    tokens`` within it, ``docs_over``, and ``truncated_tokens``."""
    each = sums.select(F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context_limit"), "*")
    fits = F.col("n_tokens") <= F.col("context_limit")
    total = lambda value: F.sum(F.when(fits, value).otherwise(0))
    over = F.sum(F.when(~fits, F.col("n_docs")).otherwise(0))
    tokens = total(F.col("n_tokens") * F.col("n_docs"))
    return each.groupBy("context_limit").agg(
        total(F.col("n_docs")).alias("docs"), tokens.alias("tokens"), over.alias("docs_over"),
        (tokens + over * F.col("context_limit")).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that this share of the documents keeps to."""
    each = sums.select(F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share"), "n_tokens", "quantile")
    return each.where("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
