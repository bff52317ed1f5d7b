"""Vulnerable dependencies in the manifests at a repository's root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.findings import FINDING, FINDINGS, capped_score, rule_table
from riskloom.functions.lines import quoted_lines
from riskloom.functions.text import SPACE, decode_utf8, let, universal_newlines
from riskloom.functions.versions import parse_version
from riskloom.operators.intervals import stab
from riskloom.operators.joins import join_measured
from riskloom.storage import materialize

DEPENDENCIES = (
    "array<struct<ecosystem:string,package:string,pinned:string,"
    "version:array<bigint>,line:int,ord:int>>"
)
ADVISORY_SEVERITY = "high"
REQUIREMENT = rf"(?U)^{SPACE}*+([a-zA-Z0-9_-]+)(?:==([0-9.]+))?"


def is_manifest(path: Column, is_symlink: Column) -> Column:
    return path.isin(rules.NPM_MANIFEST, rules.PIP_MANIFEST) & ~F.coalesce(is_symlink, F.lit(False))


def manifest_text(path: Column, content: Column) -> Column:
    """Text of a manifest. Undecodable bytes are dropped from package.json and become
    U+FFFD in requirements.txt."""
    return universal_newlines(
        F.when(path == rules.PIP_MANIFEST, F.make_valid_utf8(content.cast("string")))
        .otherwise(decode_utf8(content))
    )


def _dependency(ecosystem, package, pinned, line, i) -> Column:
    return F.struct(
        F.lit(ecosystem).alias("ecosystem"), package.alias("package"), pinned.alias("pinned"),
        parse_version(pinned).alias("version"), line.cast("int").alias("line"),
        i.cast("int").alias("ord"),
    )


def npm_dependencies(text: Column) -> Column:
    """The ``dependencies`` object, in key order; lines come from ``with_lines``. A text
    that is not one strict JSON object, and nothing after it, has none: read as the only
    element of a list, it may not be followed by anything."""
    listed = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), "array<struct<dependencies: map<string,string>>>",
        {"allowSingleQuotes": "false"},
    )
    ends = F.rlike(text, F.lit(r"\}[ \t\r\n]*+$"))
    found = let(listed, lambda objects: F.when((F.size(objects) == 1) & ends, F.get(objects, F.lit(0))["dependencies"]))
    entries = F.map_entries(found)
    return F.transform(entries, lambda e, i: _dependency(
        rules.NPM, e["key"], F.ltrim(e["value"], F.lit("^~=")), F.lit(None), i,
    )).cast(DEPENDENCIES)


def pip_dependencies(text: Column) -> Column:
    """Requirement lines. Extras and spaces around ``==`` read as unpinned."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        F.lower(F.regexp_extract(line, REQUIREMENT, 1)).alias("package"),
        F.nullif(F.regexp_extract(line, REQUIREMENT, 2), F.lit("")).alias("pinned"),
        (i + 1).alias("line"),
    ))
    named = F.filter(lines, lambda r: r["package"] != "")
    return F.transform(named, lambda r, i: _dependency(
        rules.PYPI, r["package"], r["pinned"], r["line"], i,
    )).cast(DEPENDENCIES)


def parse_manifest(path: Column, text: Column) -> Column:
    return F.when(path == rules.NPM_MANIFEST, npm_dependencies(text)).when(
        path == rules.PIP_MANIFEST, pip_dependencies(text)
    )


def with_lines(dependencies: Column, lines: Column) -> Column:
    """npm entries get the line of the first ``"name"`` in the text."""
    return F.when(lines.isNull(), dependencies).otherwise(
        F.zip_with(dependencies, lines, lambda d, line: d.withField("line", line))
    )


def _finding(detector, severity, description, line, points) -> Column:
    return F.struct(
        F.lit(detector), F.lit(severity), F.lit("vulnerable_dependency"), description,
        F.lit(None), line, F.lit(points),
    ).cast(FINDING)


def _floor_table(floors) -> Column:
    return rule_table(
        [
            {"ecosystem": ecosystem, "package": package, "floor": floor,
             "version": [int(part) for part in floor.split(".")], "reason": reason}
            for ecosystem, packages in floors.items()
            for package, (floor, reason) in packages.items()
        ],
        "ecosystem:string,package:string,floor:string,version:array<bigint>,reason:string",
    )


def floor_findings(dependencies: Column, floors=None) -> Column:
    """``array<struct<ord, finding>>`` for pins below the first good version. The ten
    floors are a constant in the expression, so no join is needed."""
    table = _floor_table(floors or rules.VERSION_FLOORS)

    def report(d, f):
        npm = F.concat(F.lit("NPM package '"), d["package"], F.lit("': "), f["reason"])
        pip = F.concat(
            F.lit("Python package '"), d["package"], F.lit("' pinned to "), d["pinned"],
            F.lit(": "), f["reason"], F.lit(" (fixed in "), f["floor"], F.lit(")"),
        )
        return F.struct(d["ord"].alias("ord"), _finding(
            "floor", "medium", F.when(d["ecosystem"] == rules.NPM, npm).otherwise(pip),
            d["line"], rules.POINTS_FLOOR,
        ).alias("finding"))

    def below(d):
        return F.transform(
            F.filter(table, lambda f: (f["ecosystem"] == d["ecosystem"])
                     & (f["package"] == d["package"]) & (d["version"] < f["version"])),
            lambda f: report(d, f),
        )

    return F.flatten(F.transform(dependencies, below))


def advisory_pins(dependencies: Column) -> Column:
    """The dependencies of a manifest with a readable version."""
    pinned = F.filter(dependencies, lambda d: d["version"].isNotNull())
    return F.transform(pinned, lambda d: F.struct(
        d["ecosystem"].alias("ecosystem"), d["package"].alias("package"),
        d["pinned"].alias("pinned"), d["version"].alias("version"),
        d["line"].alias("line"), d["ord"].alias("ord"),
    ))


def with_dependencies(rows: DataFrame) -> DataFrame:
    """Replaces ``manifest_text`` by ``dependencies, floor_hits, pins``; NULL where the
    row is no manifest. The lines of all entries of a manifest come from one pass over
    its text."""
    npm_text = F.when(F.col("path") == rules.NPM_MANIFEST, F.col("manifest_text"))
    return (
        rows.withColumn("dependencies", parse_manifest(F.col("path"), F.col("manifest_text")))
        .withColumn("npm_lines", quoted_lines(npm_text, F.col("dependencies.package")))
        .withColumn("dependencies", with_lines(F.col("dependencies"), F.col("npm_lines")))
        .withColumn("floor_hits", floor_findings(F.col("dependencies")))
        .withColumn("pins", advisory_pins(F.col("dependencies")))
        .drop("manifest_text", "npm_lines")
    )


def manifests(files: DataFrame) -> DataFrame:
    """``(repo_id, path, dependencies, floor_hits, pins)`` per root manifest."""
    path = F.col("path")
    return with_dependencies(
        files.filter(is_manifest(path, F.col("is_symlink")))
        .select("repo_id", "path", manifest_text(path, F.col("content")).alias("manifest_text"))
    )


def dependency_rows(parsed: DataFrame) -> DataFrame:
    """One row per manifest entry."""
    return parsed.select("repo_id", "path", F.inline_outer("dependencies")).filter("package is not null")


def floor_rows(parsed: DataFrame) -> DataFrame:
    return (
        parsed.select("repo_id", "path", F.inline_outer("floor_hits"))
        .filter("finding is not null")
        .select("repo_id", "path", "ord", F.lit("").alias("advisory"), "finding")
    )


PIN = ["ecosystem", "package", "pinned"]


def advisory_groups(parsed: DataFrame, advisories: DataFrame) -> DataFrame:
    """``ecosystem, package, pinned, listed`` (stored): the advisories of each pin, once
    however many manifests have it, as a list of ``advisory, text`` in report order.

    ``advisories``: ``ecosystem, package, introduced array<bigint>, fixed
    array<bigint>, id, summary, details``; a NULL bound is open. Ranges are looked up
    once per distinct version, by sorting versions and bounds together.
    """
    pins = parsed.select(F.inline_outer("pins")).filter("package is not null")
    text = F.coalesce(
        F.nullif(F.col("summary"), F.lit("")),
        F.nullif(F.left(F.col("details"), F.lit(120)), F.lit("")),
        F.lit("no summary available"),
    )
    known = advisories.select(
        "ecosystem", "package", "introduced", "fixed",
        F.coalesce(F.col("id"), F.lit("unknown")).alias("advisory"), text.alias("text"),
    )
    pinned = materialize(pins.select(*PIN, "version").distinct())
    affected = stab(
        pinned.select("ecosystem", "package", "version").distinct(), known,
        ["ecosystem", "package"], "version", "introduced", "fixed",
    )
    # one version may be written in several ways
    by_pin = affected.join(pinned, ["ecosystem", "package", "version"]).groupBy(*PIN)
    return materialize(by_pin.agg(F.sort_array(F.collect_list(F.struct("advisory", "text"))).alias("listed")))


def _affected_pins(parsed: DataFrame, groups: DataFrame) -> DataFrame:
    """The pins that have advisories, with how many (``n``) and the first one's name."""
    pins = parsed.select("repo_id", "path", F.inline_outer("pins")).filter("package is not null").drop("version")
    heads = groups.select(*PIN, F.size("listed").alias("n"), F.get("listed", F.lit(0))["advisory"].alias("first"))
    return join_measured(pins, heads, PIN, "inner", spread_by=["repo_id", "path", "ord"])


def advisory_description(entry: Column) -> Column:
    """What is said of a pin's advisory, one of its list; over the columns of ``PIN``."""
    return F.concat(
        F.col("ecosystem"), F.lit(" package '"), F.col("package"), F.lit("' "), F.col("pinned"),
        F.lit(": "), entry["advisory"], F.lit(" - "), entry["text"],
    )


def _expanded(pins: DataFrame, groups: DataFrame, most: Column | None = None) -> DataFrame:
    """A row for each advisory of a pin, with its place ``nth`` and ``advisory``, and the
    finding as columns. Nothing is shuffled behind this. ``most`` (of columns of ``pins``)
    is how many of a pin's advisories are wanted.

    The lists go to their pins, so none is repeated but for a skewed key that Spark splits."""
    listed = F.col("listed") if most is None else F.slice("listed", F.lit(1), most)
    rows = join_measured(pins, groups, PIN, "inner", spread_by=PIN, salts=1)
    each = rows.select(*pins.columns, F.posexplode(listed).alias("nth", "entry"))
    return each.select(
        *[c for c in pins.columns if c != "line"], "nth", F.col("entry.advisory").alias("advisory"),
        F.lit("advisory").alias("detector"), F.lit(ADVISORY_SEVERITY).alias("severity"),
        F.lit("vulnerable_dependency").alias("category"), advisory_description(F.col("entry")).alias("description"),
        F.lit(None).cast("string").alias("pattern"), F.col("line").cast("int").alias("line"),
        F.lit(rules.POINTS_ADVISORY).cast("int").alias("points"),
    )


def _as_finding() -> Column:
    return F.struct("detector", "severity", "category", "description", "pattern", "line", "points").cast(FINDING)


def advisory_rows(parsed: DataFrame, advisories: DataFrame) -> DataFrame:
    """One finding per advisory (see :func:`advisory_groups`) of a pinned dependency."""
    groups = advisory_groups(parsed, advisories)
    rows = _expanded(_affected_pins(parsed, groups).select("repo_id", "path", "ord", *PIN, "line"), groups)
    return rows.select("repo_id", "path", "ord", "advisory", _as_finding().alias("finding"))


@dataclass(frozen=True)
class Advised:
    """Dependency findings with the advisories of a pin told by the pin: their number is
    that of manifests times advisories, and most readers need counts or the first few.

    ``rows``: one per repository, ``repo_id, path, n_findings, risk_score`` and ``parts``, in
    report order. A part is one ``finding``, or, where that is null, ``n`` advisories of a
    pin; ``at`` is the place of its first finding, ``before`` the number of findings of the
    same severity before it. ``groups`` are those of :func:`advisory_groups`. ``files`` are
    the results that the dependencies were added to, if any. None is a caution."""

    rows: DataFrame
    groups: DataFrame
    files: DataFrame | None = None

    def findings(self, k: int | None = None, of_each: int | None = None) -> DataFrame:
        """``repo_id, path, ord`` and the columns of a finding: all of them, or at least the
        first ``k`` by severity of each repository, or ``of_each`` of each part."""
        parts = self.rows.select("repo_id", "path", F.inline("parts"))
        if k is not None:
            parts = parts.where(F.col("before") < k)
        keep = F.lit(of_each) if of_each is not None else None if k is None else F.least("n", F.lit(k) - F.col("before"))
        single = parts.where("finding is not null").select("repo_id", "path", F.col("at").alias("ord"), "finding.*")
        pins = parts.where("finding is null").select("repo_id", "path", "at", "before", "n", *PIN, "line")
        of_pins = _expanded(pins, self.groups, keep).withColumn("ord", F.col("at") + F.col("nth"))
        return single.unionByName(of_pins.select(*single.columns))


    def short(self, k: int) -> DataFrame:
        """A row for each part with one of the first ``k`` findings by severity of its
        repository: ``repo_id, path, n``, and of its first finding ``ord`` and the columns.
        A pin's has no description, and columns of ``PIN``, which are null in the others."""
        parts = self.rows.select("repo_id", "path", F.inline("parts")).where(F.col("before") < k)
        of_pin = _finding("advisory", ADVISORY_SEVERITY, F.lit(None), F.col("line"), rules.POINTS_ADVISORY)
        return parts.select(
            "repo_id", "path", F.col("at").alias("ord"), "n", *PIN, F.coalesce("finding", of_pin).alias("f"),
        ).select("repo_id", "path", "ord", "n", *PIN, "f.*")

    def with_listed(self, rows: DataFrame, k: int) -> DataFrame:
        """``rows`` with ``listed``, the first ``k`` advisories of their pin; null without one.
        Rows stay where they are unless these lists are too large to be broadcast."""
        first = self.groups.select(*PIN, F.slice("listed", 1, k).alias("listed"))
        return join_measured(rows, first, PIN, "left", spread_by=PIN, salts=1)


def advised(results: DataFrame) -> Advised | None:
    """The short form of results that ``dependency_results`` or ``scan`` gave with
    advisories; None for any other table."""
    return getattr(results, "_riskloom_advised", None)


def with_advised(results: DataFrame, short: Advised) -> DataFrame:
    results._riskloom_advised = short
    return results


def _parts(parsed: DataFrame, groups: DataFrame) -> DataFrame:
    """``Advised.rows``. Advisories of two pins at one place of a manifest (a manifest that
    came twice), or without a name, sort among others, so these are parts of their own."""
    manifest = (F.col("path") == rules.PIP_MANIFEST).cast("int").alias("manifest")
    entry = Window.partitionBy("repo_id", "path", "ord")
    hits = materialize(_affected_pins(parsed, groups).withColumn(
        "mixed", (F.count(F.lit(1)).over(entry) > 1) | (F.col("first") == "")
    ))
    pin = [*PIN, "line"]
    none = [F.lit(None).cast("string").alias(c) for c in PIN] + [F.lit(None).cast("int").alias("line")]
    one = F.lit(1).alias("n")
    mixed = _expanded(hits.where("mixed").select("repo_id", "path", "ord", *pin), groups)
    items = (
        floor_rows(parsed).select("repo_id", manifest, "ord", "advisory", "finding", one, *none)
        .unionByName(mixed.select("repo_id", manifest, "ord", "advisory", _as_finding().alias("finding"), one, *none))
        .unionByName(hits.where("not mixed").select(
            "repo_id", manifest, "ord", F.col("first").alias("advisory"), F.lit(None).cast(FINDING).alias("finding"), "n", *pin,
        ))
    )
    # equal rows may stand in any order
    above = Window.partitionBy("repo_id").orderBy("manifest", "ord", "advisory", "finding").rowsBetween(
        Window.unboundedPreceding, -1
    )
    is_high = F.col("finding").isNull() | (F.col("finding.severity") == ADVISORY_SEVERITY)
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n")).otherwise(0)).over(above), F.lit(0)).cast("int")
    placed = items.withColumns({"at": count(F.lit(True)), "high": count(is_high), "other": count(~is_high)})
    points = F.coalesce(F.col("finding.points"), F.lit(rules.POINTS_ADVISORY))
    part = F.struct("at", F.when(is_high, F.col("high")).otherwise(F.col("other")).alias("before"), "n", "finding", *pin)
    return placed.groupBy("repo_id").agg(
        F.sum("n").cast("int").alias("n_findings"),
        F.least(F.lit(rules.MAX_SCORE), F.sum(F.col("n") * points)).cast("double").alias("risk_score"),
        F.sort_array(F.collect_list(part)).alias("parts"),
    ).withColumn("path", F.lit(rules.DEPENDENCY_PATH))


def dependency_scores(results: DataFrame) -> DataFrame:
    """``repo_id, path, risk_score, n_findings`` of ``dependency_results``."""
    short = advised(results)
    if short is not None:
        return short.rows.select("repo_id", "path", "risk_score", "n_findings")
    return results.select(
        "repo_id", "path", capped_score(F.col("findings")).alias("risk_score"), F.size("findings").alias("n_findings"),
    )


def dependency_results(parsed: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """One pseudo-file ``dependencies`` per repository with findings.

    Per repository: package.json before requirements.txt, manifest order, a floor
    finding before the advisories of the same entry. Floor findings stay arrays, one
    row per manifest; two manifests per repository is all that meets in a group.

    With advisories the findings are told in short first (:class:`Advised`, stored); the
    column ``findings`` is made where it is read.
    """
    if advisories is not None:
        groups = advisory_groups(parsed, advisories)
        short = Advised(materialize(_parts(parsed, groups)), groups)
        whole = short.findings().groupBy("repo_id", "path").agg(
            F.sort_array(F.collect_list(F.struct("ord", _as_finding().alias("finding")))).alias("entries")
        )
        found = F.transform("entries", lambda e: e["finding"]).cast(FINDINGS)
        return with_advised(whole.select("repo_id", found.alias("findings"), "path"), short)
    manifest = (F.col("path") == rules.PIP_MANIFEST).cast("int")
    per_manifest = F.transform(F.col("floor_hits"), lambda h: F.struct(
        manifest.alias("manifest"), h["ord"].alias("ord"), h["finding"].alias("finding"),
    ))
    rows = parsed.where(F.size("floor_hits") > 0).select("repo_id", per_manifest.alias("entries"))
    grouped = rows.groupBy("repo_id").agg(F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries"))
    found = F.transform("entries", lambda e: e["finding"])
    return grouped.select("repo_id", found.cast(FINDINGS).alias("findings")).withColumn("path", F.lit(rules.DEPENDENCY_PATH))
