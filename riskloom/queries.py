"""Every operator as a query over the test tables: ``name -> (spark, sf_dir)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import entropy as E
from riskloom.functions import scoring as S
from riskloom.functions import text as T
from riskloom.functions.findings import hit, hits_if, is_caution, to_findings
from riskloom.operators import dependencies as deps
from riskloom.operators import encoding, patterns, paths
from riskloom.operators.dockerfile import dockerfile
from riskloom.operators.secrets import secrets
from riskloom.plans import exports, reports, summary
from riskloom.plans.chunks import scan_chunks
from riskloom.plans.scan import analyze, detectors, prepare, repo_losses, scan
from riskloom.sources import archives, chunks, corpora
from riskloom.sources.tables import files_from_text, read_table, spread_small, store_files
from riskloom.storage import materialize, shared_folder, store
from riskloom.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
FINDING_COLUMNS = ["repo_id", "path", "severity", "category", "description", "line", "points"]


# --- one detector over one corpus ----------------------------------------------

def detector(findings: Callable[[], Column], source: Query = corpora.documents_with_payloads) -> Query:
    """All findings of one detector over a whole corpus."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = prepare(source(spark, sf_dir)).select("repo_id", "path", findings().alias("findings"))
        return summary.finding_rows(found).select(*FINDING_COLUMNS)

    return query


def base64_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(corpora.documents_with_payloads(spark, sf_dir))
    return docs.select("repo_id", "path", E.high_entropy_runs(encoding.base64_shaped(F.col("text")))["n"].alias("n"))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.documents_with_payloads(spark, sf_dir)
    value = E.entropy(F.col("content"))
    return files.select("repo_id", "path", F.round(value, 6).alias("entropy")).withColumn(
        "is_high", F.col("entropy") > rules.HIGH_ENTROPY
    )


def entropy_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread_small(read_table(spark, f"{sf_dir}/pages.parquet").select("page_id", "html"))
    value = E.entropy(F.encode("html", "UTF-8"), sample_bytes=512)
    return pages.select("page_id", F.round(value, 6).alias("entropy"))


def pages_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over the raw pages."""
    return summary.finding_rows(analyze(corpora.pages_as_files(spark, sf_dir))).select(*FINDING_COLUMNS)


# --- classification and decoding -----------------------------------------------

def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary test and decoding over byte forms of all documents: plain, UTF-16 with
    mark, leading NUL, invalid byte near the end, empty, invalid byte at the start."""
    docs = spread_small(read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    form, utf8 = F.col("doc_id") % 6, F.encode("text", "UTF-8")

    def raw(data: bytes) -> Column:
        return F.lit(bytearray(data))

    content = (
        F.when(form == 0, utf8)
        .when(form == 1, F.concat(raw(b"\xff\xfe"), F.encode("text", "UTF-16LE")))
        .when(form == 2, F.concat(raw(b"\x00"), utf8))
        .when(form == 3, F.concat(utf8, raw(b"\xff\r\nend")))
        .when(form == 4, raw(b""))
        .otherwise(F.concat(raw(b"caf\xe9 "), utf8))
    )
    files = docs.select(
        F.lit("docs").alias("repo_id"), F.col("doc_id").cast("string").alias("path"),
        F.octet_length(content).cast("bigint").alias("size"), F.lit(False).alias("is_symlink"),
        content.alias("content"),
    )
    return prepare(files).select("path", "is_binary", F.char_length("text").cast("bigint").alias("chars"))


def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.file_type(F.col("path"))
    return (
        corpora.paths_from_lineitem(spark, sf_dir)
        .groupBy(kind.alias("file_type"), T.language(kind).alias("language")).agg(F.count("*").alias("n"))
    )


# --- path filters --------------------------------------------------------------

def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.paths_from_lineitem(spark, sf_dir).filter(paths.wanted()).select("repo_id", "path", "size")


def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.paths_from_lineitem(spark, sf_dir).filter(paths.wanted("quick")).select("repo_id", "path", "size")


def read_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = paths.ignore_lists(corpora.paths_from_lineitem(spark, sf_dir))
    return lists.select("repo_id", F.explode_outer("globs").alias("glob")).filter("glob is not null")


def ignore_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.paths_from_lineitem(spark, sf_dir)
    marked = paths.mark_ignored(files, paths.ignore_rules(paths.ignore_lists(files)))
    return marked.filter(~F.col("ignored")).select("repo_id", "path")


def quick_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.paths_from_lineitem(spark, sf_dir)
    return paths.select_files(files, "quick").filter("selected").select("repo_id", "path")


def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an ignore list for each source, stored with the lists set apart and
    scanned from there."""
    docs = corpora.documents_with_payloads(spark, sf_dir)
    lists = files_from_text(
        read_table(spark, f"{sf_dir}/documents.parquet").select("source").distinct(),
        F.col("source"), F.lit(rules.IGNORE_FILE), F.lit("# generated\n*.md\nes/*\n"),
    )
    folder = f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"
    return scan(store_files(docs.unionByName(lists), folder)).select("repo_id", "path", "file_type", "risk_score")


SMALL_CAP = 100


def quick_cap_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick mode with a cap that every repository reaches."""
    files = corpora.paths_from_lineitem(spark, sf_dir)
    chosen = paths.select_files(files, "quick", quick_files=SMALL_CAP)
    return chosen.filter("selected").select("repo_id", "path")


# --- dependencies --------------------------------------------------------------

def _manifest_entries(spark: SparkSession, sf_dir: str, ecosystem: str) -> DataFrame:
    rows = deps.dependency_rows(deps.manifests(corpora.manifests_from_lineitem(spark, sf_dir)))
    return rows.filter(F.col("ecosystem") == ecosystem).select(
        "repo_id", "package", "pinned", "ord",
        F.array_join(F.col("version").cast("array<string>"), ".").alias("version"),
    )


def read_npm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_entries(spark, sf_dir, rules.NPM)


def broken_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of package files of which one third lack their end and one third go on
    behind it: both are no JSON object and have none."""
    files = corpora.manifests_from_lineitem(spark, sf_dir).filter(F.col("path") == rules.NPM_MANIFEST)
    form = F.floor(F.substring_index("repo_id", "_", -1).cast("bigint") / 2) % 3
    text = F.col("content").cast("string")
    broken = F.when(form == 0, F.regexp_replace(text, r"\}\s*$", "")).when(form == 2, F.concat(text, F.lit("x"))).otherwise(text)
    rows = deps.dependency_rows(deps.manifests(files.withColumn("content", F.encode(broken, "UTF-8"))))
    return rows.select("repo_id", "package", "pinned", "ord", "line")


def read_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest_entries(spark, sf_dir, rules.PYPI)


def _floors(spark: SparkSession, sf_dir: str, manifest: str) -> DataFrame:
    rows = deps.floor_rows(deps.manifests(corpora.manifests_from_lineitem(spark, sf_dir)))
    return rows.filter(F.col("path") == manifest).select(
        "repo_id", "path", "ord", "finding.severity", "finding.description", "finding.line", "finding.points"
    )


def npm_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _floors(spark, sf_dir, rules.NPM_MANIFEST)


def pip_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _floors(spark, sf_dir, rules.PIP_MANIFEST)


def advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = materialize(deps.manifests(corpora.manifests_from_lineitem(spark, sf_dir)).drop("dependencies"))
    rows = deps.advisory_rows(parsed, corpora.advisories_from_part(spark, sf_dir))
    return rows.select(
        "repo_id", "path", "ord", "finding.severity", "finding.description", "finding.line", "finding.points"
    )


def dep_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = materialize(deps.manifests(corpora.manifests_from_lineitem(spark, sf_dir)).drop("dependencies"))
    return deps.dependency_scores(deps.dependency_results(parsed, corpora.advisories_from_part(spark, sf_dir)))


# --- file scores ---------------------------------------------------------------

def _scores(results: DataFrame) -> DataFrame:
    cautions = F.size(F.filter("findings", lambda f: is_caution(f["severity"])))
    return results.select(
        "repo_id", "path", "file_type", "risk_score", S.band(F.col("risk_score")).alias("risk_level"),
        (F.size("findings") - cautions).alias("n_findings"), cautions.alias("n_cautions"),
    )


def file_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(analyze(corpora.documents_with_payloads(spark, sf_dir)))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors with their position in the file."""
    found = summary.finding_rows(analyze(corpora.documents_with_payloads(spark, sf_dir)))
    return found.select("repo_id", "path", "ord", "severity", "category", "description", "pattern", "line")


def caution_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.finding_rows(analyze(corpora.documents_with_payloads(spark, sf_dir)))
    return found.groupBy("is_caution", "severity", "category").agg(
        F.count("*").alias("n"), F.sum("points").alias("points")
    )


# --- repository verdicts over the full corpus ----------------------------------

def scanned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of documents, build files and manifests with advisories."""
    return scan(corpora.corpus(spark, sf_dir), advisories=corpora.advisories_from_part(spark, sf_dir))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.repo_summary(scanned_corpus(spark, sf_dir))


COUNTS = [
    "repo_id", "total_files", "overall_risk_score", "risk_level", "high_risk_files",
    "medium_risk_files", "low_risk_files", "safe_files", "findings_count", "cautions_count",
]


def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.rollup(scanned_corpus(spark, sf_dir)).select(*COUNTS)


def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = summary.verdicts(_summary(spark, sf_dir))
    return verdict.select(
        *COUNTS, "findings_reported", "cautions_reported", "status", "recommendation",
        "score_bar", "threshold_exceeded",
    )


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per web host over the raw pages."""
    return summary.rollup(scan(corpora.pages_as_files(spark, sf_dir))).select(*COUNTS)


def top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ranked_findings(scanned_corpus(spark, sf_dir)).select(
        "repo_id", "is_caution", "rank", "path", "ord", "severity", "category", "description", "line"
    )


def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.detailed(scanned_corpus(spark, sf_dir))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate at every level, over the repositories' scores."""
    score = F.col("overall_risk_score")
    levels = ["none", *(name for name, _ in reversed(rules.BANDS))]
    return summary.rollup(scanned_corpus(spark, sf_dir)).select(
        "repo_id", *[S.exceeds(score, level).alias(f"fail_on_{level}") for level in levels]
    )


def multi_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report figures over the order totals as scores, 0 to 100 and beyond."""
    orders = read_table(spark, f"{sf_dir}/orders.parquet")
    score = F.col("o_totalprice") % 13000 / 100
    return orders.select("o_orderkey", score.alias("score")).select(
        "o_orderkey", *[F.round(c, 6).alias(name) for c, name in zip(
            S.multi_factor(F.col("score")), ["code_quality", "security", "obfuscation", "malicious"])],
        S.score_bar(F.col("score"), 10).alias("score_bar"),
        S.band(F.col("score")).alias("risk_level"),
        S.status(F.col("score")).alias("status"),
        S.recommendation(F.col("score")).alias("recommendation"),
    )


def repo_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = ["", ".git", "/", ".io.git/", ".git.git"]
    url = F.concat(F.lit("https://git.example.com/team/"), F.replace(F.col("s_name"), F.lit("#"), F.lit(".")),
                   corpora.pick(endings, F.col("s_suppkey")))
    return read_table(spark, f"{sf_dir}/supplier.parquet").select("s_suppkey", S.repo_name(url).alias("repo_name"))


def sarif_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["/tmp/clone1/src/", "src\\lib\\", "/etc/", "/tmp/clone10/", "pkg/"]
    path = F.concat(corpora.pick(forms, F.col("o_orderkey")), F.col("o_orderpriority"))
    uri = reports.sarif_uri(path, "/tmp/clone1")
    return read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", uri.alias("uri"))


# --- reports -------------------------------------------------------------------

def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per category, over all findings."""
    return reports.rule_rows(scanned_corpus(spark, sf_dir))


def findings_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.export_rows(scanned_corpus(spark, sf_dir))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a CSV report, over all findings."""
    return findings_export(spark, sf_dir).select(
        "repo_id", "position", "File", "Line", "Severity", "Category", "Description"
    )


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of documents and build files, written in all formats to a folder of
    each repository (compressed), and read back from there."""
    folder = f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/reports-{uuid.uuid4().hex}"
    files = corpora.documents_with_payloads(spark, sf_dir).unionByName(corpora.dockerfiles_from_orders(spark, sf_dir))
    exports.export_all(scan(files), folder, by_repo=True, compression="gzip")
    return exports.read_back(spark, folder)


SARIF_SCHEMA = (
    "runs array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, "
    "region: struct<startLine: int>>>>>>>>"
)


def sarif_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs, read back from their text."""
    logs = reports.sarif_logs(_summary(spark, sf_dir)).select("repo_id", F.from_json("report", SARIF_SCHEMA).alias("log"))
    results = logs.select("repo_id", F.posexplode_outer(F.col("log.runs")[0]["results"]).alias("position", "r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return results.filter("r is not null").select(
        "repo_id", "position", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"),
        F.col("r.message.text").alias("message"), place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].alias("line"),
    )


JSON_ENTRY = "array<struct<file: string, severity: string, category: string, description: string, line: int>>"
JSON_SCHEMA = (
    "repo_name string, repo_url string, total_files bigint, overall_risk_score double, risk_level string, "
    f"findings_count bigint, cautions_count bigint, findings {JSON_ENTRY}, cautions {JSON_ENTRY}"
)


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports, read back from their text."""
    url = F.concat(F.lit("https://git.example.com/"), F.col("repo_id"))
    texts = reports.json_reports(_summary(spark, sf_dir), repo_url=url)
    parsed = texts.select(F.from_json("report", JSON_SCHEMA).alias("r")).select("r.*")
    listed = F.concat("findings", "cautions")
    return parsed.select(
        F.col("repo_name").alias("repo_id"), "repo_url", "total_files", "overall_risk_score", "risk_level",
        "findings_count", "cautions_count", F.posexplode_outer(listed).alias("position", "f"),
    ).select("*", "f.*").drop("f")


# --- branches that plain data does not reach ------------------------------------

def oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that claim more than 50 MB: noted, and scanned all the same unless the
    caller sets a cap."""
    files = corpora.documents_with_payloads(spark, sf_dir)
    big = files.withColumn("size", F.when(F.char_length("path") % 3 == 0, F.col("size") + rules.MAX_FILE_BYTES).otherwise(F.col("size")))
    modes = {"whole": analyze(big), "capped": analyze(big, max_bytes=rules.MAX_FILE_BYTES)}
    noted = F.exists("findings", lambda f: f["category"] == "size")
    tables = [t.select(F.lit(m).alias("mode"), "repo_id", "path", "risk_score", noted.alias("noted")) for m, t in modes.items()]
    return tables[0].union(tables[1])


def high_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of 2 KB of digests beside plain texts."""
    docs = spread_small(read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    digest = lambda i: F.unhex(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(i))).cast("binary"), 256))
    noise = F.concat(*(digest(i) for i in range(64)))
    files = docs.select(
        F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("path"), F.lit(2048).cast("bigint").alias("size"),
        F.lit(False).alias("is_symlink"), F.when(F.col("doc_id") % 2 == 0, noise).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )
    found = summary.finding_rows(analyze(files)).filter("detector = 'entropy' or description like 'High entropy%'")
    return found.select("repo_id", "path", "severity", "category", "points")


def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files could not be read."""
    files = corpora.documents_with_payloads(spark, sf_dir)
    lost = F.char_length("path") % 2 == 0
    files = files.withColumn("content", F.when(~lost, F.col("content"))).withColumn(
        "read_error", F.when(lost, F.lit("Permission denied"))
    )
    found = summary.finding_rows(analyze(files)).filter("category = 'error'")
    return found.select("repo_id", "path", "severity", "description", "points")


def read_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all documents, and some that are cut off, read in small ranges."""
    files = archives.read_archives(spark, corpora.archives_from_documents(spark, sf_dir), range_bytes=64 << 10)
    return files.select(
        "repo_id", "path", "size", F.sha2("content", 256).alias("sha256"), F.col("read_error").isNotNull().alias("failed")
    )


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the documents and build files, scanned in chunks of about 1 KB."""
    files = corpora.documents_with_payloads(spark, sf_dir).unionByName(corpora.dockerfiles_from_orders(spark, sf_dir))
    found = summary.finding_rows(scan_chunks(chunks.cut_files(files, chunk_bytes=1 << 10)))
    return found.select("repo_id", "path", "ord", "severity", "category", "description", "pattern", "line", "points")


OWN_RULES = {
    "malicious": {"team": [r"foo\.bar", "lorem"], "prose": [r"the .{0,200}of", "and"]},
    "dangerous": {"python": ["the "], "bash": ["a", "of "]},
    "network": [(r"http", "Plain link")],
    "secret": {"Word in qu": r"(qu[a-z]{4,9})"},
}


def own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents under a caller's rules, without the detectors of entropy and lines,
    and with a detector of the caller's: a note on texts with a certain letter."""
    own = detectors(**OWN_RULES)
    for name in ("entropy", "long_line", "base64", "dockerfile"):
        del own[name]
    own["accent"] = lambda: to_findings("accent", hits_if((
        F.contains(F.col("text"), F.lit("ê")), hit("accent", "Has an accent", points=1),
    )))
    found = summary.finding_rows(scan(corpora.documents_with_payloads(spark, sf_dir), own=own))
    return found.select("repo_id", "path", "ord", "severity", "category", "description", "pattern", "line", "points")


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of arriving files, scored and appended to a table."""
    arrived = store(corpora.documents_with_payloads(spark, sf_dir))
    folder = f"{arrived}-stream"
    results = arrivals.scan_arrivals(arrivals.read_arrivals(spark, arrived))
    arrivals.write_results(results, f"{folder}/results", f"{folder}/checkpoint").awaitTermination()
    return _scores(spark.read.schema(results.schema).parquet(f"{folder}/results"))


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in two batches: first all, of which some in another form, then
    those anew, and stale forms of others. Every file counts once, by its newest form."""
    docs = corpora.documents_with_payloads(spark, sf_dir)
    other = F.encode(F.lit("eval(x)\nos.system(y)\n# minerd"), "UTF-8")
    again = F.char_length("path") % 2 == 0
    first = docs.withColumns({"content": F.when(again, other).otherwise(F.col("content")), "version": F.lit(2).cast("bigint")})
    second = docs.withColumns({
        "content": F.when(again, F.col("content")).otherwise(other),
        "version": F.when(again, F.lit(3)).otherwise(F.lit(1)).cast("bigint"),
    })
    arrived = store(first)
    folder = f"{arrived}-rollup"
    results = arrivals.scan_arrivals(arrivals.read_arrivals(spark, arrived, arrivals.VERSIONED_SCHEMA))
    changes = arrivals.result_changes(results)
    for late in (None, second):
        if late is not None:
            late.write.mode("append").parquet(arrived)
        arrivals.write_results(changes, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return arrivals.rollup_changes(spark.read.schema(changes.schema).parquet(f"{folder}/changes")).select(*COUNTS)


def counted_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of unknown size and files that failed: by repository, and as counted in the
    scan itself, whose results hold the others."""
    docs = corpora.documents_with_payloads(spark, sf_dir)
    unknown, lost = F.char_length("path") % 3 == 0, F.char_length("path") % 2 == 0
    files = docs.withColumns({
        "size": F.when(~unknown, F.col("size")), "content": F.when(~lost, F.col("content")),
        "read_error": F.when(lost, F.lit("Permission denied")),
    })
    counted = Observation("losses")
    results = scan(files, lost=counted)
    held = results.groupBy("repo_id").agg(F.count("*").alias("results"))
    total = counted.get
    whole = results.agg(F.lit("(all)").alias("repo_id"), *(F.lit(total[c]).cast("bigint").alias(c) for c in ("listed", "dropped", "failed")),
                        F.count("*").alias("results"))
    return repo_losses(files).join(held, "repo_id").unionByName(whole)


def _text() -> Column:
    return F.col("text")


def _folded() -> Column:
    return F.col("folded")


QUERIES: dict[str, Query] = {
    "malicious": detector(lambda: patterns.malicious(_folded())),
    "long_line": detector(lambda: patterns.long_lines(_text())),
    "dangerous_fn": detector(lambda: patterns.dangerous_functions(_text(), F.col("file_type"))),
    "network": detector(lambda: patterns.network(_folded())),
    "encoding": detector(lambda: encoding.base64_findings(_text(), _folded(), F.col("runs"))),
    "secrets": detector(lambda: secrets(_text(), _folded())),
    "dockerfile": detector(lambda: dockerfile(_text(), F.col("name")), corpora.dockerfiles_from_orders),
    "base64_count": base64_count,
    "entropy": entropy,
    "entropy_sample": entropy_sample,
    "pages_findings": pages_findings,
    "classify": classify,
    "file_type": file_type,
    "path_filter": path_filter,
    "size_filter": size_filter,
    "read_ignore": read_ignore,
    "ignore_anti": ignore_anti,
    "quick_cap": quick_cap,
    "read_npm": read_npm,
    "read_pip": read_pip,
    "npm_floor": npm_floor,
    "pip_floor": pip_floor,
    "advisory": advisory,
    "dep_score": dep_score,
    "file_score": file_score,
    "all_findings": all_findings,
    "caution_split": caution_split,
    "band_counts": band_counts,
    "repo_summary": repo_summary,
    "scan_pages": scan_pages,
    "top50": top50,
    "top10": top10,
    "gate": gate,
    "multi_factor": multi_factor,
    "repo_name": repo_name,
    "sarif_uri": sarif_uri,
    "sarif_rules": sarif_rules,
    "csv_rows": csv_rows,
    "findings_export": findings_export,
    "export_files": export_files,
    "oversize": oversize,
    "high_entropy": high_entropy,
    "read_errors": read_errors,
    "read_archives": read_archives,
    "sarif_log": sarif_log,
    "json_report": json_report,
    "stream_scan": stream_scan,
    "chunk_scan": chunk_scan,
    "stored_scan": stored_scan,
    "quick_cap_small": quick_cap_small,
    "broken_manifests": broken_manifests,
    "stream_rollup": stream_rollup,
    "counted_losses": counted_losses,
    "own_rules": own_rules,
}
