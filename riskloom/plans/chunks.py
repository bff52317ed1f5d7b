"""The scan of huge files, whose contents come in chunks.

Every chunk is scanned by itself, like a file. What that leaves (hits, newlines, base64
runs, counts of byte values) is small, and is put together per file: lines are moved by
the newlines above a chunk, the first hit of a pattern is kept, counts add up, and
severities and score are decided from the whole. The result equals that of ``analyze``
over the uncut files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import entropy as E
from riskloom.functions import text as T
from riskloom.functions.findings import HIT, capped_score, no_findings, to_findings
from riskloom.operators import encoding, patterns
from riskloom.operators.dockerfile import dockerfile, dockerfile_severity
from riskloom.operators.paths import wanted
from riskloom.operators.secrets import secrets
from riskloom.plans.scan import RESULT_COLUMNS, oversize, prepare
from riskloom.storage import materialize

FILE = ["repo_id", "path"]


def _place(keys: list[str], key: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, keys)), key).cast("int")


def _malicious_rule(h: Column) -> Column:
    keys = [f"{category} {pattern}" for category, group in rules.MALICIOUS_PATTERNS.items() for pattern in group]
    return _place(keys, F.concat_ws(" ", h["category"], h["pattern"]))


def _function_rule(h: Column) -> Column:
    keys = [f"{language} {name}" for language, names in rules.DANGEROUS_FUNCTIONS.items() for name in names]
    name = F.substring_index(h["description"], "Dangerous function: ", -1)
    return _place(keys, F.concat_ws(" ", T.language(F.col("file_type")), name))


def _secret_rule(h: Column) -> Column:
    return _place(list(rules.SECRET_PATTERNS), F.substring_index(h["description"], " detected: ", 1))


def _call_rule(h: Column) -> Column:
    return _place([description for _, description, _ in rules.BASE64_CALLS], h["description"])


def _network_rule(h: Column) -> Column:
    return _place([label for _, label in rules.NETWORK_PATTERNS], h["description"])


def _no_rule(_: Column) -> Column:
    return F.lit(0)


# name -> (order of its rules, whether a rule counts once a file, severity), in report order
_KINDS: dict[str, tuple[Callable[[Column], Column], bool, object]] = {
    "malicious": (_malicious_rule, True, patterns.malicious_severity),
    "long_line": (_no_rule, False, "low"),
    "dangerous_fn": (_function_rule, True, "low"),
    "base64": (_call_rule, True, encoding.encoding_severity),
    "network": (_network_rule, True, "low"),
    "secrets": (_secret_rule, False, "critical"),
    "dockerfile": (_no_rule, False, dockerfile_severity),
}


def _chunk_hits() -> Column:
    """All hits of a chunk as ``array<struct<kind, rule, chunk, ord, hit>>``."""
    text, folded = F.col("text"), F.col("folded")
    found = {
        "malicious": patterns.malicious(folded),
        "long_line": patterns.long_lines(text),
        "dangerous_fn": patterns.dangerous_functions(text, F.col("file_type")),
        "base64": encoding.base64_calls(text, folded),
        "network": patterns.network(folded),
        "secrets": secrets(text, folded),
        "dockerfile": dockerfile(text, F.col("name")),
    }

    def keyed(kind: int, name: str) -> Column:
        hits = F.transform(found[name], lambda h, i: F.struct(
            F.lit(kind).alias("kind"), _KINDS[name][0](h).alias("rule"), F.col("chunk").alias("chunk"), i.alias("ord"),
            F.struct(*(h[c] for c in ("category", "description", "pattern", "line", "points"))).cast(HIT).alias("hit"),
        ))
        return F.coalesce(hits, F.array().cast(f"array<struct<kind:int,rule:int,chunk:bigint,ord:int,hit:{HIT}>>"))

    return F.concat(*(keyed(kind, name) for kind, name in enumerate(_KINDS)))


def scan_each_chunk(chunks: DataFrame) -> DataFrame:
    """One small row per chunk; the only step that reads contents, and a narrow one."""
    ready = prepare(chunks.filter(F.col("size").isNotNull()), "counts", few_runs=0)
    text, runs = F.col("text"), F.col("runs")
    return ready.select(
        *FILE, "size", "file_type", "is_binary", "chunk", F.col("entropy").alias("byte_counts"),
        E.entropy_of_counts(F.col("entropy")).alias("own_entropy"),
        F.coalesce(T.newlines(text), F.lit(0)).cast("bigint").alias("newlines"),
        F.coalesce(runs["n"], F.lit(0)).cast("bigint").alias("n_runs"),
        F.when(runs["n"] > 0, T.line_of_literal(text, runs["first"])).alias("run_line"),
        _chunk_hits().alias("hits"),
    )


def file_entropy(scanned: DataFrame) -> DataFrame:
    """``repo_id, path, entropy`` of the files of several chunks, from the summed counts of
    byte values; at most 256 rows of a file meet. A single chunk has its ``own_entropy``, so
    its counts are not laid out in rows."""
    several = scanned.select(*FILE, "byte_counts", F.count(F.lit(1)).over(Window.partitionBy(*FILE)).alias("n_chunks")).where(
        "n_chunks > 1"
    )
    counts = several.select(*FILE, F.explode("byte_counts").alias("x"))
    counts = counts.groupBy(*FILE, F.col("x").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum(F.shiftright("x", 8)).alias("n"))
    total, n = F.sum("n"), F.col("n")
    # log2(total) - sum(n log2 n) / total
    entropy = F.log2(total) - F.sum(n * F.log2(n)) / total
    return counts.groupBy(*FILE).agg(F.abs(entropy).alias("entropy"))


def _merged(kind: int, name: str) -> Column:
    """The hits of one kind over the sorted hits of a file."""
    of_kind = F.filter("hits", lambda x: x["kind"] == kind)
    if _KINDS[name][1]:
        of_kind = T.let(of_kind, lambda all_: F.filter(
            all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["rule"] != x["rule"])
        ))
    return F.transform(of_kind, lambda x: x["hit"])


def merge_chunks(scanned: DataFrame) -> DataFrame:
    """One result per file (``RESULT_COLUMNS``) from the rows of its chunks. What meets per
    file are its hits, which are its result, and some numbers a chunk. Chunks without a
    repository or path make up no file."""
    scanned = scanned.where("repo_id is not null and path is not null")
    above = F.coalesce(F.sum("newlines").over(
        Window.partitionBy(*FILE).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ), F.lit(0)).cast("int")
    placed = scanned.withColumn("above", above).select(
        *FILE, "size", "file_type", "is_binary", "chunk", "n_runs", "own_entropy",
        F.col("byte_counts").isNotNull().alias("read"), (F.col("run_line") + F.col("above")).alias("run_line"),
        F.transform("hits", lambda x: x.withField(
            "hit", x["hit"].withField("line", x["hit"]["line"] + F.col("above"))
        )).alias("hits"),
    )
    files = placed.groupBy(*FILE).agg(
        F.max("size").alias("size"), F.max("file_type").alias("file_type"), F.max("is_binary").alias("is_binary"),
        F.sum("n_runs").cast("int").alias("n_runs"), F.min("run_line").alias("run_line"),
        F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.count(F.lit(1)).alias("n_chunks"), F.max("own_entropy").alias("own_entropy"), F.bool_or("read").alias("read"),
    )
    own = F.when(F.col("n_chunks") == 1, F.col("own_entropy"))
    # content of no bytes has entropy 0; no content has none
    measured = files.join(file_entropy(scanned), FILE, "left").withColumn(
        "entropy", F.coalesce(own, "entropy", F.when(F.col("read"), F.lit(0.0)))
    )
    found = [oversize(), F.coalesce(encoding.high_entropy(F.col("entropy")), no_findings())]
    for kind, name in enumerate(_KINDS):
        hits = _merged(kind, name)
        if name == "base64":
            hits = F.concat(encoding.counted_runs(F.col("n_runs"), F.col("run_line")), hits)
        found.append(to_findings(name, hits, _KINDS[name][2]))
    return measured.withColumn("findings", F.concat(*found)).withColumn(
        "risk_score", capped_score(F.col("findings"))
    ).select(*RESULT_COLUMNS)


def scan_chunks(chunks: DataFrame, mode: str = "balanced") -> DataFrame:
    """File results of files in chunks (``riskloom.sources.chunks``), to be united with
    those of ``scan``. Only the path and size filters are applied; a null ``size`` drops
    the file, and a file without content (null) has no findings but for its size."""
    return merge_chunks(materialize(scan_each_chunk(chunks.filter(wanted(mode)))))
