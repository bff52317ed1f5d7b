"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule is a host and a beginning of the path, such as ``example.org/en/``. It fits its
host and all subdomains. Of the rules that fit a URL the longest decides; a URL that none
fits is judged by boosted trees over what its characters show: lengths, depth, share of
digits, entropy, parameters, and how often URLs of its host's suffixes were blocked among
the labelled ones. All of it is column expressions and Spark's own tree learner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.storage import materialize

#: Labelled URLs that the trees are fitted on at most, about, chosen by hash.
MOST_LABELS = 20_000
TREES, DEPTH, STEP = 20, 4, 0.2
#: Labelled URLs that a suffix must outweigh for its own rate to count half.
SUFFIX_PRIOR = 10
PARTITIONS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[tuple[str, str]], host: Column, path: Column, pick: int) -> Column:
    """Of the longest fitting rule its verdict (``pick`` 0) or itself (1); null if none fits."""
    column = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        column = F.when(fits, (verdict, rule)[pick]).otherwise(column)
    return column


def _count(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.char_length(text)
    signs = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    bits = F.transform(F.filter(signs, lambda c: c != ""), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda s, b: s + b)).otherwise(0.0)


def _suffixes(host: Column) -> dict[str, Column]:
    return {"top": F.substring_index(host, ".", -1), "second": F.substring_index(host, ".", -2)}


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "labels": _count(host, "."), "depth": _count(path, "/"), "dashes": _count(host, "-"),
        "digit_ratio": (F.char_length(url) - F.char_length(F.regexp_replace(url, "[0-9]+", "")))
        / F.greatest(F.char_length(url), F.lit(1)),
        "entropy": _entropy(url), "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(url, F.lit("https")).cast("int"),
    }


def url_table(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """``page_id, url, host, path`` and the features of each URL."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    figures = features(F.col("url"), F.col("host"), F.col("path"))
    return parts.select(
        "page_id", "url", "host", "path", *(c.cast("double").alias(name) for name, c in figures.items()),
        *(c.alias(name) for name, c in _suffixes(F.col("host")).items()),
    )


def _with_rates(urls: DataFrame, labelled: DataFrame, base: float) -> DataFrame:
    """The smoothed share of blocked URLs among labelled ones of the same suffixes. The
    suffixes of at most ``MOST_LABELS`` rows are broadcast."""
    for name in ("top", "second"):
        n = F.count("*")
        rates = labelled.groupBy(name).agg(
            ((F.sum("label") + SUFFIX_PRIOR * base) / (n + SUFFIX_PRIOR)).alias(f"{name}_rate"), n.alias(f"{name}_seen")
        )
        urls = urls.join(F.broadcast(rates), name, "left").fillna({f"{name}_rate": base, f"{name}_seen": 0})
    return urls


def _inputs(urls: DataFrame) -> list[str]:
    plain = ("page_id", "url", "host", "path", "top", "second", "label", "rule", "ruled")
    return sorted(c for c in urls.columns if c not in plain and not c.endswith("_seen"))


def fit_trees(urls: DataFrame, labelled: DataFrame, seed: int = 0) -> GBTClassificationModel | None:
    """The trees, from ``labelled`` rows with ``label`` (1: block); None without both kinds."""
    if labelled.select("label").distinct().count() < 2:
        return None
    table = VectorAssembler(inputCols=_inputs(urls), outputCol="features").transform(labelled)
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=seed,
        subsamplingRate=1.0,
    )
    return learner.fit(table.select("features", F.col("label").cast("double")))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", most_labels: int = MOST_LABELS, seed: int = 0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every row of ``pages``.

    ``labelled`` has ``url, label`` (1: block). Without it the URLs that a rule decides
    are the labelled ones, with the rule's verdict. The trees are fitted on about
    ``most_labels`` of them at most. A null URL, an empty one, or one without ``://`` has
    an empty host and path and no rule. Without labels of both kinds the trees allow all.
    Repeated rows are repeated in the result; ties of rules can't be, as rules are told
    apart by their text. Other columns are not read.
    """
    host, path = F.col("host"), F.col("path")
    urls = materialize(
        url_table(pages, id_col, url_col)
        .withColumn("rule", rule_of(rules, host, path, 1)).withColumn("ruled", rule_of(rules, host, path, 0))
    )
    if labelled is None:
        known = urls.where("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("int"))
    else:
        known = url_table(labelled.select(F.col("label").alias("page_id"), "url"), "page_id", "url")
        known = known.where("page_id is not null").withColumn("label", F.col("page_id").cast("int"))
    total = known.count()
    if total > most_labels:
        share = int(2**31 * most_labels / total)
        known = known.where(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(2**31)) < share)
    sample = materialize(known.coalesce(PARTITIONS))
    base = sample.agg(F.avg("label")).first()[0] or 0.0
    trees = fit_trees(_with_rates(urls, sample, base), _with_rates(sample, sample, base), seed)
    scored = _with_rates(urls, sample, base)
    if trees is None:
        scored = scored.withColumn("block_score", F.lit(0.0))
    else:
        scored = trees.transform(VectorAssembler(inputCols=_inputs(scored), outputCol="features").transform(scored))
        scored = scored.withColumn("block_score", vector_to_array("probability")[1])
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "block_score")
