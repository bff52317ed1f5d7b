"""Rolling file results up to one verdict per repository.

A repository may hold a third of all files. Counts are plain aggregates, combined
before the shuffle; ranked lists go through the salted top-k, after each file has been
cut to the k findings it could at most contribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import scoring as S
from riskloom.functions.findings import is_caution, severity_rank
from riskloom.operators.dependencies import PIN, advised, advisory_description
from riskloom.operators.topk import top_k
from riskloom.storage import materialize

LISTED = (
    "array<struct<path:string,severity:string,category:string,description:string,"
    "pattern:string,line:int>>"
)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def band_counts() -> list[Column]:
    """Files per band; high and critical share one counter."""
    level = S.band(F.col("risk_score"))
    return [
        _count(level.isin("critical", "high")).alias("high_risk_files"),
        _count(level == "medium").alias("medium_risk_files"),
        _count(level == "low").alias("low_risk_files"),
        _count(level == "safe").alias("safe_files"),
    ]


def _counted(results: DataFrame) -> DataFrame:
    """``repo_id, risk_score, n_findings, n_cautions`` of each file."""
    short = advised(results)
    files = results if short is None else short.files
    cautions = F.size(F.filter("findings", lambda f: is_caution(f["severity"])))
    counted = files.select(
        "repo_id", "risk_score", (F.size("findings") - cautions).alias("n_findings"), cautions.alias("n_cautions"),
    )
    if short is None:
        return counted
    return counted.unionByName(short.rows.select("repo_id", "risk_score", "n_findings", F.lit(0).alias("n_cautions")))


def rollup(results: DataFrame) -> DataFrame:
    """Counts, totals before any truncation, and the overall score per repository."""
    totals = _counted(results).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("overall_risk_score"),
        *band_counts(),
        F.sum("n_findings").alias("findings_count"),
        F.sum("n_cautions").alias("cautions_count"),
    )
    return totals.withColumn("risk_level", S.band(F.col("overall_risk_score")))


def finding_rows(results: DataFrame, of_each: int | None = None) -> DataFrame:
    """One row per finding, with its position ``ord`` in the file. Of the advisories of a
    pin, which differ in description only, ``of_each`` are enough for the caller if given.

    The outer form keeps the optimizer from testing the list's size below the
    projection that builds it, which would run all detectors twice.
    """
    short = advised(results)
    files = results if short is None else short.files
    found = (
        files.select("repo_id", "path", F.posexplode_outer("findings").alias("ord", "f"))
        .filter(F.col("f").isNotNull())
        .select("repo_id", "path", "ord", "f.*", is_caution(F.col("f.severity")).alias("is_caution"))
    )
    if short is None:
        return found
    return found.unionByName(short.findings(of_each=of_each).withColumn("is_caution", F.lit(False)))


def _first_per_file(findings: Column, k: int) -> Column:
    """The k first findings and the k first cautions a file can contribute."""
    keyed = F.transform(findings, lambda f, i: F.struct(
        severity_rank(f["severity"]).alias("severity_rank"), i.alias("ord"), f.alias("f"),
    ))

    def first(caution: bool) -> Column:
        one_kind = F.filter(keyed, lambda x: is_caution(x["f"]["severity"]) == F.lit(caution))
        return F.slice(F.sort_array(one_kind), 1, k)

    return F.concat(first(False), first(True))


_FINDING = ["detector", "severity", "category", "description", "pattern", "line", "points"]
_RANKED = ["repo_id", "path", "ord", "severity_rank", *_FINDING, "is_caution", "rank"]
#: Findings whose texts one task makes.
ROWS_A_TASK = 200_000


def _ranked(results: DataFrame, k: int) -> DataFrame:
    """The first k findings and cautions of each repository, ranked: ``_RANKED`` and how many
    findings a row stands for (``taken``). With advisories told by pin, a row may be a run of
    those of one pin, told by its first; texts of these are made behind the ranking, by
    ``_with_found``."""
    short = advised(results)
    files = results if short is None else short.files
    rows = (
        files.select("repo_id", "path", F.explode_outer(_first_per_file(F.col("findings"), k)).alias("x"))
        .filter(F.col("x").isNotNull())
        .select(
            "repo_id", "path", "x.ord", "x.severity_rank", "x.f.*",
            is_caution(F.col("x.f.severity")).alias("is_caution"),
        )
    )
    order = [F.col("severity_rank"), F.col("path"), F.col("ord")]
    group = ["repo_id", "is_caution"]
    if short is None:
        return top_k(rows, group, order, k, spread_by=["path", "ord"]).withColumn("taken", F.lit(1))
    pins = short.short(k).withColumns({
        "severity_rank": severity_rank(F.col("severity")), "is_caution": F.lit(False), "of_file": F.lit(False),
    })
    rows = rows.withColumns({"n": F.lit(1), "of_file": F.lit(True)}).unionByName(pins, allowMissingColumns=True)
    first = top_k(rows, group, order, k, spread_by=["path", "ord"]).drop("rank")
    # findings of a file that is named like these rows stand among those of a pin
    among = F.max(F.col("of_file") & (F.col("path") == rules.DEPENDENCY_PATH)).over(Window.partitionBy(*group))
    alone = F.col("among") & (F.col("n") > 1)
    placed = first.withColumn("among", among).withColumn(
        "nth", F.explode(F.when(alone, F.sequence(F.lit(0), F.least("n", F.lit(k)) - 1)).otherwise(F.array(F.lit(0))))
    ).withColumns({"ord": F.col("ord") + F.col("nth"), "n": F.when(alone, 1).otherwise(F.col("n"))})
    above = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("rank", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).cast("int")).where(F.col("rank") <= k)
    return materialize(
        ranked.withColumn("taken", F.least("n", F.lit(k + 1) - F.col("rank"))).select(*_RANKED, "taken", "nth", *PIN)
    )


def _with_found(results: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``ranked`` rows (of ``_ranked``, more columns may be there) with ``found``, the findings
    that each stands for. Rows of a repository meet first, while they are short, and in
    partitions that hold so many findings that their texts need no disk."""
    one = F.array(F.struct(*(c for c in _RANKED if c not in ("repo_id", "is_caution"))))
    short = advised(results)
    if short is None:
        return ranked.withColumn("found", one)
    wide = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = (ranked.agg(F.sum("taken")).first()[0] or 0) // ROWS_A_TASK + 1
    rows = short.with_listed(ranked.repartition(max(wide, tasks), "repo_id"), k)
    mine = F.slice("listed", F.col("nth") + 1, F.col("taken"))
    told = F.transform(mine, lambda entry, i: F.struct(
        "path", (F.col("ord") + i).alias("ord"), "severity_rank", "detector", "severity", "category",
        advisory_description(entry).alias("description"), "pattern", "line", "points", (F.col("rank") + i).alias("rank"),
    ))
    return rows.withColumn("found", F.when(F.col("package").isNull(), one).otherwise(told)).drop("listed")


def ranked_findings(results: DataFrame, k: int = rules.REPORT_LIMIT) -> DataFrame:
    """First k findings and, separately, first k cautions per repository: by severity,
    then path, then position in the file."""
    ranked = _ranked(results, k)
    if advised(results) is None:
        return ranked.select(*_RANKED)
    return _with_found(results, ranked, k).select("repo_id", "is_caution", F.inline("found")).select(*_RANKED)


def _lists(results: DataFrame, k: int) -> DataFrame:
    """``ranked_lists``, with the lengths of the lists."""
    def listed(caution: bool) -> Column:
        chosen = F.collect_list(F.when(
            F.col("is_caution") == F.lit(caution), F.struct("rank", F.col("found").alias("found"))
        ))
        ranked = F.flatten(F.transform(F.sort_array(chosen), lambda x: x["found"]))
        return F.transform(ranked, lambda f: F.struct(
            f["path"].alias("path"), f["severity"].alias("severity"), f["category"].alias("category"),
            f["description"].alias("description"), f["pattern"].alias("pattern"), f["line"].alias("line"),
        ))

    def reported(caution: bool) -> Column:
        return F.sum(F.when(F.col("is_caution") == F.lit(caution), F.col("taken")).otherwise(0)).cast("int")

    return _with_found(results, _ranked(results, k), k).groupBy("repo_id").agg(
        listed(False).alias("findings"), listed(True).alias("cautions"),
        reported(False).alias("findings_reported"), reported(True).alias("cautions_reported"),
    )


def ranked_lists(results: DataFrame, k: int = rules.REPORT_LIMIT) -> DataFrame:
    """``(repo_id, findings, cautions)``: the ranked rows as two lists of at most k."""
    return _lists(results, k).select("repo_id", "findings", "cautions")


def repo_summary(results: DataFrame, k: int = rules.REPORT_LIMIT) -> DataFrame:
    """One row per repository. Reads ``results`` twice, so pass a stored table
    (as :func:`riskloom.plans.scan.scan` returns) rather than a plan over contents."""
    empty = F.array().cast(LISTED)
    joined = rollup(results).join(_lists(results, k), "repo_id", "left")
    return joined.withColumns({
        "findings": F.coalesce(F.col("findings").cast(LISTED), empty),
        "cautions": F.coalesce(F.col("cautions").cast(LISTED), empty),
        "findings_reported": F.coalesce("findings_reported", F.lit(0)),
        "cautions_reported": F.coalesce("cautions_reported", F.lit(0)),
    })


def verdicts(summary: DataFrame, fail_on: str = "high") -> DataFrame:
    """Adds labels, the four factors and the pass/fail gate."""
    score = F.col("overall_risk_score")
    return summary.select(
        "*",
        S.status(score).alias("status"),
        S.recommendation(score).alias("recommendation"),
        S.score_bar(score).alias("score_bar"),
        *S.multi_factor(score),
        S.exceeds(score, fail_on).alias("threshold_exceeded"),
    )


def detailed(results: DataFrame, k: int = rules.DETAIL_LIMIT) -> DataFrame:
    """The first ten findings and cautions per repository as report lines, with how
    many of how many are shown."""
    totals = rollup(results).select("repo_id", "findings_count", "cautions_count")
    total = F.when(F.col("is_caution"), F.col("cautions_count")).otherwise(F.col("findings_count"))
    label = F.when(F.col("is_caution"), "CAUTION").otherwise(F.upper("severity"))
    ranked = _ranked(results, k).join(totals, "repo_id")
    found = _with_found(results, ranked, k).select(
        "repo_id", "is_caution", "findings_count", "cautions_count", F.inline("found")
    )
    return found.select(
        "repo_id", "is_caution", "rank", label.alias("label"),
        F.concat(
            S.location(F.col("path"), F.col("line")), F.lit(" "), F.col("category"), F.lit(": "),
            S.short_description(F.col("description")),
        ).alias("report_line"),
        F.least(total, F.lit(k)).cast("bigint").alias("shown"), total.alias("total"),
    )
