"""From a table of files to one scored result per file.

The whole file step is narrow: one read of each file, no shuffle. Findings stay an
array on the file's row until the score is known.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import entropy as E
from riskloom.functions import text as T
from riskloom.functions.findings import capped_score, hit, hits_if, no_findings, or_none, to_findings
from riskloom.operators import dependencies as deps
from riskloom.operators import encoding, patterns
from riskloom.operators.dockerfile import dockerfile
from riskloom.operators.paths import select_files
from riskloom.operators.secrets import secrets
from riskloom.storage import materialize


def prepare(
    files: DataFrame, entropy_of: str = "all", max_bytes: int | None = None, few_runs: int = rules.BASE64_FEW,
) -> DataFrame:
    """Classify and decode: adds ``name, file_type, is_binary, entropy, text, folded,
    runs``.

    ``text`` is NULL for binary files, and for files over ``max_bytes`` if that is
    given, which no detector reads then. ``entropy_of="candidates"`` measures only files
    whose entropy can exceed the limit; the others stay NULL. ``"counts"`` gives the counts
    of the byte values in its place.

    A ``head`` column, the first bytes of the file that the content is a part of, tells
    binary files and UTF-16 in place of the content. ``few_runs`` or less base64 runs are
    not counted.
    """
    content, utf16 = F.col("content"), F.col("utf16")
    head = F.col("head") if "head" in files.columns else content
    probe = F.when(E.may_have_high_entropy(content), content) if entropy_of == "candidates" else content
    readable = files.withColumns({
        "name": T.file_name(F.col("path")),
        "file_type": T.file_type(F.col("path")),
        "content": content if max_bytes is None else F.when(F.col("size") <= max_bytes, content),
    })
    decoded = readable.withColumn("plain", F.when(
        ~T.has_utf16_mark(head) & ~T.is_binary(head),
        T.universal_newlines(T.decode_utf8(content)),
    ))
    measured = decoded.withColumns({
        "entropy": E.byte_counts(content) if entropy_of == "counts" else E.entropy(probe),
        "utf16": E.utf16(F.when(T.has_utf16_mark(head), content)),
        "runs": encoding.base64_runs(F.col("plain"), few_runs),
    }).drop("content", "head")
    text = measured.withColumn(
        "text", F.coalesce(F.col("plain"), T.universal_newlines(utf16["text"]))
    )
    return text.withColumns({
        "is_binary": F.col("text").isNull(),
        "runs": F.when(F.col("plain").isNull(), F.struct(
            utf16["n"].alias("n"), utf16["first"].alias("first")
        )).otherwise(F.col("runs")),
        "folded": T.fold(F.col("text")),
    }).drop("plain", "utf16")


Detector = Callable[[], Column]


def detectors(
    malicious: Mapping[str, list[str]] | None = None,
    dangerous: Mapping[str, list[str]] | None = None,
    network: list[tuple[str, str]] | None = None,
    secret: Mapping[str, str] | None = None,
) -> dict[str, Detector]:
    """All detectors in report order, by name, with the built-in rules where none are given.

    Each is a function without arguments that gives ``array<FINDING>`` over the columns of
    :func:`prepare`. Leave out, replace or add entries, and hand the dict to ``scan`` or
    ``analyze``. Patterns of ``malicious`` and ``network`` are matched in lower case.
    """
    text, folded = F.col("text"), F.col("folded")
    return {
        "entropy": lambda: encoding.high_entropy(F.col("entropy")),
        "malicious": lambda: patterns.malicious(folded, malicious),
        "long_line": lambda: patterns.long_lines(text),
        "dangerous_fn": lambda: patterns.dangerous_functions(text, F.col("file_type"), dangerous),
        "base64": lambda: encoding.base64_findings(text, folded, F.col("runs")),
        "network": lambda: patterns.network(folded, network),
        "secrets": lambda: secrets(text, folded, secret),
        "dockerfile": lambda: dockerfile(text, F.col("name")),
    }


@lru_cache(maxsize=1)
def _built_in(_context) -> list[Column]:
    return [build() for build in detectors().values()]


def text_findings(own: Mapping[str, Detector] | None = None) -> list[Column]:
    """The findings of each detector. Those of the built-in ones depend on no data and are
    built once per Spark context."""
    return _built_in(SparkContext.getOrCreate()) if own is None else [or_none(build()) for build in own.values()]


def oversize() -> Column:
    return to_findings("size", hits_if((
        F.col("size") > rules.MAX_FILE_BYTES,
        hit("size", f"File exceeds max size ({rules.MAX_FILE_MB}MB)"),
    )))


def read_errors(files: DataFrame) -> Column:
    """Sources may say in ``read_error`` why a file could not be read in full."""
    if "read_error" not in files.columns:
        return no_findings()
    return to_findings("error", hits_if((
        F.col("read_error").isNotNull(),
        hit("error", F.concat(F.lit("Error reading file: "), F.col("read_error"))),
    )))


def losses(files: DataFrame) -> list[Column]:
    """Counts of files: ``listed`` in all, ``dropped`` as their size is unknown, and
    ``failed``, those that a source says it could not read, or not whole. Contents are not
    looked at."""
    failed = F.col("read_error").isNotNull() if "read_error" in files.columns else F.lit(False)
    return [
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("size").isNull()).alias("dropped"),
        F.count_if(F.col("size").isNotNull() & failed).alias("failed"),
    ]


def repo_losses(files: DataFrame) -> DataFrame:
    """``losses`` of each repository."""
    return files.groupBy("repo_id").agg(*losses(files))


RESULT_COLUMNS = [
    "repo_id", "path", "size", "file_type", "is_binary", "entropy", "findings", "risk_score",
]


def analyze(
    files: DataFrame, entropy_of: str = "all", keep: list[str] | None = None, max_bytes: int | None = None,
    own: Mapping[str, Detector] | None = None,
) -> DataFrame:
    """One result per file (``RESULT_COLUMNS``, plus the columns in ``keep``). Files of
    unknown size are dropped. Files over 50 MB get a note; their content is read like
    any other unless ``max_bytes`` says from which size on it is not. ``own`` detectors
    (see :func:`detectors`) take the place of the built-in ones."""
    prepared = prepare(files.filter(F.col("size").isNotNull()), entropy_of, max_bytes)
    found = F.concat(oversize(), *text_findings(own), read_errors(files))
    unread = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    return prepared.select(
        "repo_id", "path", "size", "file_type",
        (F.col("is_binary") & ~unread).alias("is_binary"),
        "entropy", found.alias("findings"), *(keep or []),
    ).withColumn("risk_score", capped_score(F.col("findings"))).select(*RESULT_COLUMNS, *(keep or []))


def scan_pass(
    files: DataFrame, mode: str = "balanced", max_bytes: int | None = None, own: Mapping[str, Detector] | None = None,
) -> DataFrame:
    """Everything that needs file contents, in one narrow pass over the files.

    Manifests are parsed whether or not the file filters keep them; ``selected`` says
    whether the row is also a file result.
    """
    manifest = deps.is_manifest(F.col("path"), F.col("is_symlink"))
    rows = (
        select_files(files, mode)
        .filter(F.col("selected") | manifest)
        .withColumn("manifest_text", F.when(manifest, deps.manifest_text(F.col("path"), F.col("content"))))
        .withColumn("content", F.when(F.col("selected"), F.col("content")))
    )
    parsed = deps.with_dependencies(rows)
    return analyze(parsed, keep=["selected", "floor_hits", "pins"], max_bytes=max_bytes, own=own)


def file_results(scanned: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """File results of a scan pass, plus one ``dependencies`` row per repository with
    vulnerable pins (stored, as a summary reads the results more than once; those with
    advisories in the short form, which summaries and reports read)."""
    files = scanned.filter("selected").select(*RESULT_COLUMNS)
    found = deps.dependency_results(scanned.filter("floor_hits is not null"), advisories)
    short = deps.advised(found)
    dependency_rows = materialize(found) if short is None else found
    results = files.unionByName(dependency_rows.select(
        "repo_id", "path", F.lit(0).cast("bigint").alias("size"),
        F.lit("unknown").alias("file_type"), F.lit(False).alias("is_binary"),
        F.lit(0.0).alias("entropy"), "findings",
        capped_score(F.col("findings")).alias("risk_score"),
    ))
    return results if short is None else deps.with_advised(results, replace(short, files=files))


def scan(
    files: DataFrame, mode: str = "balanced", advisories: DataFrame | None = None,
    max_bytes: int | None = None, own: Mapping[str, Detector] | None = None,
    lost: Observation | None = None,
) -> DataFrame:
    """Scan a corpus, with ``own`` detectors if given. ``lost.get`` holds the ``losses`` of
    the whole corpus afterwards, counted in the same pass. The pass over the contents is written to the shared folder once;
    summaries and reports then read only its small result rows."""
    seen = files if lost is None else files.observe(lost, *losses(files))
    return file_results(materialize(scan_pass(seen, mode, max_bytes, own)), advisories)
