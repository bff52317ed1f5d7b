"""The operators as queries over the whole tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.alignment import TOKENIZER_A, TOKENIZER_B, align
from riskloom.llm.chat import chat_digests, format_chats
from riskloom.llm.digests import exact_groups
from riskloom.llm.jaccard import jaccard_components
from riskloom.llm.lengths import TOKENIZER, length_histogram, suffix_sums, token_counter
from riskloom.llm.lines import fuzzy_lines
from riskloom.llm.mixing import mix_sources
from riskloom.llm.positional import contamination, phrase_matches
from riskloom.llm.prefixes import rebuilt_trie
from riskloom.llm.substrings import remaining, remove_repeats
from riskloom.llm.suffixes import byte_digests, remove_repeated_bytes
from riskloom.llm.toxicity import toxicity_scores
from riskloom.llm.urls import judge_urls
from riskloom.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]

#: The mix that the corpus aims at; sources belong to domains by their number.
DOMAINS = ("web", "books", "forum")
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
MIX_EPOCHS, MIX_PERCENT, MIX_SEED = 2, 80, 17

URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
#: A conversation whose texts hold control strings, formatted besides those of the table.
HARD_CHAT = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of_source():
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)", 1).try_cast("long") % 3
    return F.when(number == 0, DOMAINS[0]).when(number == 1, DOMAINS[1]).otherwise(DOMAINS[2])


def mixed(docs: DataFrame) -> DataFrame:
    return mix_sources(
        docs, domain=domain_of_source(), weights=MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED,
        budget_percent=MIX_PERCENT,
    )


def op1_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = token_counter(spark, TOKENIZER)
    # stored, as the sums read it twice
    return suffix_sums(materialize(length_histogram(_table(spark, sf_dir, "documents"), counter)))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=5, similarity=75)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remaining(*remove_repeats(_table(spark, sf_dir, "documents"), least=50))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(_table(spark, sf_dir, "documents"), distance=16, percent=90)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = phrase_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return contamination(matches, percent=5).drop("spans", "items")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    hard = spark.createDataFrame(HARD_CHAT, "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(*columns).unionByName(hard)
    return chat_digests(format_chats(turns))


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"), TOKENIZER_A, TOKENIZER_B)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_digests(remove_repeated_bytes(_table(spark, sf_dir, "documents"), least=100))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_lengths": op1_lengths,
    "op2_jaccard": op2_jaccard,
    "op3_substrings": op3_substrings,
    "op4_mixing": op4_mixing,
    "op5_lines": op5_lines,
    "op6_decontaminate": op6_decontaminate,
    "op7_urls": op7_urls,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_exact": op10_exact,
    "op11_alignment": op11_alignment,
    "op12_suffixes": op12_suffixes,
    "op13_prefixes": op13_prefixes,
}
