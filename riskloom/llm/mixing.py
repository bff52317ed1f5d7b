"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree of domains, their languages and their sources. At
each node it is divided among the children by weight. A child that has fewer tokens than
its share (in ``max_epochs`` passes over its documents) gives the shortage to its
siblings, by their weights; only what the whole node lacks goes to the node's own
siblings, one level up. A child's capacity is that of its whole subtree, so one step a
level, from the root down, settles this.

Each leaf then takes a prefix of its tokens from seeded epochs: whole passes first, and
of the last pass the documents of the lowest keys whose tokens fit the rest. Keys are
digests of seed, pass and id. The end of the prefix is found by summing tokens over ranges
of keys, then over ranges inside the range where it ends, so the documents of a leaf are
never sorted in one task: a window sees 256 sums, or 1 / 65,536 of a leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.storage import materialize

LEAF = ["domain", "lang", "source"]
#: Hex digits of a key in each round of the search for the end of a prefix.
DIGITS = 2


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    plain = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"[\x20\x09-\x0D]+"))).cast("long")


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    """The weight of a node by its name; 1 where none is given."""
    column = F.lit(1)
    for key, weight in weights.items():
        column = F.when(F.col(name) == key, weight).otherwise(column)
    return column.cast("long")


def divide(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (with ``budget`` of the parent, ``weight`` and ``capacity``) and what
    each is ``given``. Children are filled up in order of capacity by weight; shares of
    the others are rounded down to whole tokens."""
    node = W.partitionBy(*parent)
    order = node.orderBy(F.col("capacity") / F.col("weight"), name)
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    step = (
        children.where("weight > 0")
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("full", F.col("capacity") * F.sum("weight").over(after) <= F.col("weight") * F.col("left"))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.expr("if(full, capacity, 0)")).over(node), F.lit(0)))
        .withColumn("shares", F.sum(F.expr("if(full, 0, weight)")).over(node))
    )
    return step.withColumn("given", F.expr("if(full, capacity, (weight * left) div shares)")).drop("left", "full", "shares")


def leaf_budgets(
    leaves: DataFrame, budget: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]]
) -> DataFrame:
    """``domain, lang, source, tokens, given`` from ``domain, lang, source, tokens``."""
    level = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    # only children with weight count towards what a node can take
    sources = level.withColumn("weight", _weight("source", weights.get("source", {})))
    able = F.sum(F.expr("if(weight > 0, capacity, 0)")).alias("capacity")
    langs = sources.groupBy("domain", "lang").agg(able).withColumn("weight", _weight("lang", weights.get("lang", {})))
    domains = langs.groupBy("domain").agg(able).withColumn("weight", _weight("domain", weights.get("domain", {})))
    down = lambda table: table.select(F.col("given").alias("budget"), *(c for c in LEAF if c in table.columns))
    top = divide(domains.withColumn("budget", F.lit(budget).cast("long")).withColumn("root", F.lit(0)), ["root"], "domain")
    middle = divide(langs.join(down(top), "domain"), ["domain"], "lang")
    return divide(sources.join(down(middle), ["domain", "lang"]), ["domain", "lang"], "source").select(
        *LEAF, "tokens", "given"
    )


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _digits(round_: int) -> Column:
    return F.substring("key", 1 + round_ * DIGITS, DIGITS)


def _cut(keyed: DataFrame, round_: int) -> DataFrame:
    """For each leaf the range of keys in which its prefix ends, and the tokens before it."""
    sums = keyed.groupBy(*LEAF, "room", _digits(round_).alias("range")).agg(F.sum("n_tokens").alias("n"))
    leaf = W.partitionBy(*LEAF).orderBy("range")
    reached = sums.withColumn("upto", F.sum("n").over(leaf)).where("upto > room")
    return reached.groupBy(*LEAF).agg(
        F.min("range").alias(f"cut{round_}"), F.min(F.expr("upto - n")).alias(f"before{round_}")
    )


def mix_sources(
    docs: DataFrame, budget: int | None = None, *, domain: Column | None = None,
    weights: Mapping[str, Mapping[str, int]] | None = None, max_epochs: int = 2, seed: int = 0,
    budget_percent: int = 80, tokens: Column | None = None, id_col: str = "doc_id", lang_col: str = "lang",
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, n_tokens``: one row for each time that a
    document is in the mix.

    ``budget`` is in tokens; without it ``budget_percent`` of all tokens of ``docs``.
    ``weights`` has integers (up to 10,000) by name for ``domain``, ``lang`` and
    ``source``, 1 where none is given; nodes of weight 0 get nothing. ``domain`` and
    ``tokens`` are columns over ``docs``; the defaults are one domain and the words of the
    text. Shares are rounded down, and a last pass takes whole documents only, so a leaf
    may stay under its share by less than one document. Null names are empty ones, null
    texts have no token. Documents without tokens are in whole passes and before the end
    of the last one. Repeated rows count and are drawn each for itself. Other columns are
    not read. An empty table gives an empty mix.
    """
    weights = weights or {}
    name = lambda column: F.coalesce(column.cast("string"), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        name(domain if domain is not None else F.lit("all")).alias("domain"),
        name(F.col(lang_col)).alias("lang"), name(F.col(source_col)).alias("source"),
        (tokens if tokens is not None else word_count(F.col(text_col))).cast("long").alias("n_tokens"),
    ))
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    if budget is None:
        budget = (rows.agg(F.sum("n_tokens")).first()[0] or 0) * budget_percent // 100
    given = materialize(
        leaf_budgets(leaves, budget, max_epochs, weights).where("given > 0")
        .withColumn("passes", F.expr("given div tokens")).withColumn("room", F.expr("given % tokens"))
    )
    keyed = materialize(
        rows.join(given.select(*LEAF, "passes", "room"), LEAF).withColumn("key", _key(seed, F.col("passes")))
    )
    last = keyed.where("room > 0")
    first_cut = materialize(_cut(last, 0))
    inside = last.join(first_cut, LEAF).where(_digits(0) == F.col("cut0")).withColumn("room", F.expr("room - before0"))
    second_cut = materialize(_cut(inside, 1))
    cuts = first_cut.join(second_cut, LEAF)
    placed = last.join(cuts, LEAF)
    at = F.struct(_digits(0), _digits(1))
    end = F.struct("cut0", "cut1")
    before_end = placed.where(at < end)
    in_order = W.partitionBy(*LEAF).orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    at_end = placed.where(at == end).withColumn("upto", F.sum("n_tokens").over(in_order)).where(
        "upto <= room - before0 - before1"
    )
    columns = ["doc_id", *LEAF]
    whole = keyed.where("passes > 0").select(
        *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("epoch"), "n_tokens"
    )
    part = lambda table: table.select(*columns, F.col("passes").alias("epoch"), "n_tokens")
    return whole.union(part(before_end)).union(part(at_end))
