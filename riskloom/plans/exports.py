"""Reports over all findings, as files of any size.

A report holds every finding and caution of a repository, and a repository may hold a
third of all of them. So no report is ever one string: it is a sequence of lines. All
findings are sorted once, by ranges, which may split a repository; each task then writes
the lines of its range, in order, to a part file for each format. The part files, in order
of name, are the reports:

* JSON and SARIF 2.1.0: a JSON text sequence (RFC 7464), one document a repository, each
  after a record separator: ``cat report.json/part-* | jq --seq .findings``
* CSV: one table with a column ``Repository`` and one header.

So there are as many files as tasks, however many repositories. Where these are few,
``by_repo`` writes a folder ``repo_id=<repository>`` for each instead, whose part files are
one plain document (CSV: one table without the column).

The texts of a finding in all formats are many times what a scan stores of it, but are much
alike, so ``compression="gzip"`` makes them small; ``zcat`` then takes the place of ``cat``.

All formats come from the same sorted rows. The lines that open, divide and close a
document are rows too, sorted to their places, so nothing is put together outside of
Spark's own text writer.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators.joins import join_measured
from riskloom.plans import reports
from riskloom.plans.summary import rollup
from riskloom.storage import materialize

FORMATS = ("json", "csv", "sarif")
CSV_COLUMNS = ["File", "Line", "Severity", "Category", "Description"]
_CSV_OPTIONS = {
    "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "",
}
#: Stands before each document of a JSON text sequence (a fixed value).
RECORD = "\x1e"
#: Places of the lines of a document: findings and cautions come after what opens them.
OPENS, FINDINGS, DIVIDES, CAUTIONS, CLOSES = range(5)
_ORDER = ["repo_id", "stage", "severity_rank", "File", "position", "row"]


@dataclass(frozen=True)
class Export:
    """What became of one requested report: ``state`` is ``written``, ``unsupported`` or
    ``failed``, the last with the reason in ``error``."""

    path: str
    format: str
    state: str
    error: str | None = None


def _keep_nulls(body: Column) -> Column:
    return F.to_json(body, {"ignoreNullFields": "false"})


def _string(value: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def report_lines(
    results: DataFrame, formats: tuple[str, ...] = FORMATS, scan_root: str = "", repo_url: Column | None = None,
    scan_duration: Column | None = None, by_repo: bool = False,
) -> DataFrame:
    """``repo_id, stage, severity_rank, File, position, row`` (the order of lines) and one
    column of text for each format, null where a format has no line there.

    ``repo_url`` and ``scan_duration`` are columns over the totals of a repository. Files
    without a repository are one report, under the empty name."""
    return _written(_rows(results, formats, repo_url, scan_duration, by_repo), formats, scan_root, by_repo)


def _rows(
    results: DataFrame, formats: tuple[str, ...] = FORMATS, repo_url: Column | None = None,
    scan_duration: Column | None = None, by_repo: bool = False,
) -> DataFrame:
    """What becomes a line, each with its place: entries as columns, the others as text. The
    texts of an entry, one a format, are several times its size, so these rows are what is
    sorted."""
    results = results.withColumn("repo_id", F.coalesce("repo_id", F.lit("")))
    found = materialize(
        reports.export_rows(results).withColumn("stage", F.when(F.col("is_caution"), CAUTIONS).otherwise(FINDINGS))
        .withColumn("row", F.monotonically_increasing_id())
    )
    place = F.struct("severity_rank", "File", "position", "row")
    first = lambda stage: F.min(F.when(F.col("stage") == stage, place))
    firsts = materialize(found.groupBy("repo_id").agg(
        first(FINDINGS).alias("first_finding"), first(CAUTIONS).alias("first_caution"),
    ))
    # a comma stands before each entry but the first of its list
    ordered = join_measured(found, firsts, ["repo_id"], "inner", spread_by=["row"])
    begins = place == F.when(F.col("stage") == FINDINGS, F.col("first_finding")).otherwise(F.col("first_caution"))
    begins_all = begins & ((F.col("stage") == FINDINGS) | F.col("first_finding").isNull())
    entries = ordered.select(
        *_ORDER, "Line", "Severity", "Category", "Description", begins.alias("begins"), begins_all.alias("begins_all")
    )
    frames = _frames(results, found, repo_url, scan_duration, by_repo)
    none = F.lit(None)
    rows = frames.select(
        "repo_id", "stage", none.cast("int").alias("severity_rank"), none.cast("string").alias("File"),
        none.cast("int").alias("position"), none.cast("long").alias("row"), *formats,
    )
    if not by_repo and "csv" in formats:  # the one header, before all repositories
        header = F.lit(",".join(["Repository", *CSV_COLUMNS]))
        first_row = results.sparkSession.range(1).select(
            none.cast("string").alias("repo_id"), F.lit(OPENS).alias("stage"),
            *(header.alias(f) if f == "csv" else none.cast("string").alias(f) for f in formats),
        )
        rows = rows.unionByName(first_row, allowMissingColumns=True)
    return entries.unionByName(rows, allowMissingColumns=True)


def _written(rows: DataFrame, formats: tuple[str, ...], scan_root: str = "", by_repo: bool = False) -> DataFrame:
    """``_rows`` as ``report_lines``, each where it is."""
    comma = lambda is_first, text: F.concat(F.when(is_first, "").otherwise(","), text)

    entry = F.struct(
        F.col("File").alias("file"), F.col("Severity").alias("severity"), F.col("Category").alias("category"),
        F.col("Description").alias("description"), F.col("Line").alias("line"),
    )
    artifact = F.struct(reports.sarif_uri(F.col("File"), scan_root).alias("uri")).alias("artifactLocation")
    region = F.when(F.col("Line").isNotNull(), F.struct(F.col("Line").alias("startLine"))).alias("region")
    result = F.struct(
        F.col("Category").alias("ruleId"), reports.sarif_level(F.col("Severity")).alias("level"),
        F.struct(F.col("Description").alias("text")).alias("message"),
        F.array(F.struct(F.struct(artifact, region).alias("physicalLocation"))).alias("locations"),
    )
    line_of = {
        "json": comma(F.col("begins"), _keep_nulls(entry)),
        "csv": F.to_csv(F.struct(*(F.col(c).cast("string") for c in [*([] if by_repo else ["repo_id"]), *CSV_COLUMNS])), _CSV_OPTIONS),
        "sarif": comma(F.col("begins_all"), F.to_json(result)),
    }
    is_entry = F.col("stage").isin(FINDINGS, CAUTIONS)
    return rows.select(*_ORDER, *(F.when(is_entry, line_of[f]).otherwise(F.col(f)).alias(f) for f in formats))


def _frames(results: DataFrame, found: DataFrame, repo_url: Column | None, scan_duration: Column | None, by_repo: bool) -> DataFrame:
    """The lines that open, divide and close the documents of each repository."""
    totals = rollup(results)
    mark = "" if by_repo else RECORD
    head = _keep_nulls(F.struct(
        F.col("repo_id").alias("repo_name"),
        (F.lit(None).cast("string") if repo_url is None else repo_url).alias("repo_url"),
        (F.lit(None).cast("double") if scan_duration is None else scan_duration).alias("scan_duration"),
        "total_files", "overall_risk_score", "risk_level", "high_risk_files", "medium_risk_files", "low_risk_files",
        "safe_files", "findings_count", "cautions_count",
    ))
    # a repository has as many rules as there are categories, some dozens
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"),
        F.struct(F.replace("rule_id", F.lit("_"), F.lit(" ")).alias("text")).alias("shortDescription"),
        F.struct(F.col("level").alias("level")).alias("defaultConfiguration"),
    )
    listed = reports.rules_of(found).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("position", rule.alias("rule")))).alias("rules")
    )
    per_repo = totals.join(listed, "repo_id", "left").select(
        "repo_id", F.substring(head, F.lit(1), F.length(head) - 1).alias("head"),
        F.coalesce(F.to_json(F.col("rules.rule")), F.lit("[]")).alias("rules"),
    )
    tool = F.concat(
        F.lit(mark + '{"$schema":'), _string(F.lit(rules.SARIF_SCHEMA)), F.lit(f',"version":"{rules.SARIF_VERSION}",'),
        F.lit(f'"runs":[{{"tool":{{"driver":{{"name":"{reports.TOOL_NAME}","version":"{reports.TOOL_VERSION}","rules":'),
        F.col("rules"), F.lit('}},"automationDetails":{"id":'), _string(F.col("repo_id")), F.lit('},"results":['),
    )
    none = F.lit(None).cast("string")
    frame = lambda stage, json, csv, sarif: F.struct(
        F.lit(stage).alias("stage"), json.alias("json"), csv.alias("csv"), sarif.alias("sarif")
    )
    return per_repo.select("repo_id", F.inline(F.array(
        frame(
            OPENS, F.concat(F.lit(mark), "head", F.lit(',"findings":[')),
            F.lit(",".join(CSV_COLUMNS)) if by_repo else none, tool,
        ),
        frame(DIVIDES, F.lit('],"cautions":['), none, none),
        frame(CLOSES, F.lit("]}"), none, F.lit("]}]}")),
    )))


def _sorted(
    results: DataFrame, formats: tuple[str, ...], scan_root: str = "", by_repo: bool = False, **options
) -> DataFrame:
    """``report_lines`` sorted by ranges; stored by the writer in the order of the part files'
    names. Lines are put together behind the shuffle."""
    return _written(_rows(results, formats, by_repo=by_repo, **options).repartitionByRange(*_ORDER), formats, scan_root, by_repo)


def export_all(
    results: DataFrame, folder: str, formats: tuple[str, ...] = FORMATS, by_repo: bool = False,
    compression: str = "none", **options
) -> None:
    """All formats in one pass over the sorted findings, committed together:
    ``folder/format=<format>/part-*``, or with ``by_repo`` a folder of each repository in
    these. ``compression`` is that of the text writer, ``options`` are those of ``report_lines``."""
    lines = _sorted(results, formats, by_repo=by_repo, **options)
    each = F.array(*(F.struct(F.lit(f).alias("format"), F.col(f).alias("line")) for f in formats))
    rows = lines.select(*_ORDER, F.inline(each)).where("line is not null")
    folders = ["format", "repo_id"] if by_repo else ["format"]
    # in the order that the writer wants, so that it doesn't sort again
    ordered = rows.sortWithinPartitions("format", *_ORDER).select(*folders, "line")
    ordered.write.partitionBy(*folders).text(folder, compression=compression)


def export_reports(
    results: DataFrame, paths: list[str] | None, by_repo: bool = False, **options
) -> list[Export]:
    """Each path in the format of its extension (any case), a folder of part files. The lines of all formats are made and sorted once, and stored; a
    path then takes its own column of them. One that cannot be written keeps none of the
    others back. ``options`` are those of ``report_lines``."""
    wanted = [(path, posixpath.splitext(path)[1].lower().removeprefix(".")) for path in paths or ()]
    formats = tuple(f for f in FORMATS if f in {kind for _, kind in wanted})
    if not formats:
        return [Export(path, kind, "unsupported") for path, kind in wanted]
    # the number of its range keeps a stored line in its place when files are read anew
    stored = materialize(
        _sorted(results, formats, by_repo=by_repo, **options).withColumn("part", F.spark_partition_id())
    )
    parts = stored.agg(F.max("part")).first()[0] or 0

    def one(path: str, kind: str) -> Written:
        if kind not in FORMATS:
            return Export(path, kind, "unsupported")
        own = stored.where(F.col(kind).isNotNull()).select("part", *_ORDER, F.col(kind).alias("line"))
        placed = own.repartitionByRange(parts + 1, "part").sortWithinPartitions(*_ORDER)
        try:
            if by_repo:
                placed.select("repo_id", "line").write.partitionBy("repo_id").text(path)
            else:
                placed.select("line").write.text(path)
        except Exception as error:  # whatever a sink may raise
            return Export(path, kind, "failed", str(error))
        return Export(path, kind, "written")

    return [one(path, kind) for path, kind in wanted]


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """``format, repo_id, file, line, level, category, description``: the entries of the
    reports that ``export_all`` wrote ``by_repo``, parsed line by line, so texts may hold no line end.
    Part files after the first of a repository have no header, so the CSV reader's own
    handling of it would not do."""
    lines = spark.read.text(folder).withColumn("value", F.regexp_replace("value", r"^,(?=\{)", ""))
    of = lambda name: lines.where(F.col("format") == name)
    columns = ["format", "repo_id", "file", "line", "level", "category", "description"]
    listed = of("json").where(F.startswith(F.col("value"), F.lit('{"file":'))).select("format", "repo_id", F.from_json(
        "value", "file string, line int, severity string, category string, description string").alias("e"))
    table = of("csv").where(F.col("value") != ",".join(CSV_COLUMNS)).select("format", "repo_id", F.from_csv(
        "value", "file string, line int, severity string, category string, description string", _CSV_OPTIONS).alias("e"))
    flat = listed.unionByName(table).select("format", "repo_id", "e.*").withColumnRenamed("severity", "level")
    place = "locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>"
    logged = of("sarif").where(F.startswith(F.col("value"), F.lit('{"ruleId":'))).select("format", "repo_id", F.from_json(
        "value", f"ruleId string, level string, message struct<text: string>, {place}").alias("e"))
    at = F.col("e.locations")[0]["physicalLocation"]
    return flat.select(*columns).unionByName(logged.select(
        "format", "repo_id", at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"),
        F.col("e.level").alias("level"), F.col("e.ruleId").alias("category"), F.col("e.message.text").alias("description"),
    ))
