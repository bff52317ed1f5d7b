"""Container build files, checked line by line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.findings import hit, hits_if, to_findings, total_points
from riskloom.functions.text import NOT_SPACE as N
from riskloom.functions.text import SPACE as S
from riskloom.functions.text import WORD as W
from riskloom.functions.text import WORD_END, fold, let

# What each instruction check accepts.
_I = "(?idU)"
FROM = rf"{_I}^{S}*FROM{S}+({N}+)(?:{S}+AS{S}+({N}+))?"
USER = rf"{_I}^{S}*USER{S}+{N}+"
USER_ROOT = rf"{_I}^{S}*USER{S}+(?:root|0){WORD_END}"
# Possessive flags on a line without trailing space: same source as with
# backtracking, but thousands of flags cannot exhaust the stack.
ADD = rf"{_I}^{S}*ADD{S}+(?:--{N}+{S}+)*+({N}+)"
PIPE_TO_SHELL = rf"{_I}(?:curl|wget){S}++.{{0,500}}\|{S}*(?:sudo{S}+)?(?:sh|bash){WORD_END}"
INSECURE_TLS = rf"{_I}--no-check-certificate|curl{S}++.{{0,500}}(?:-k{WORD_END}|--insecure)"
ENV_ARG = rf"{_I}^{S}*(?:ENV|ARG){S}+(.*)$"
HARDCODED_SECRET = (
    rf"{_I}(?:PASSWORD|SECRET|TOKEN|API_KEY){W}{{0,64}}"
    rf"(?:{S}{{0,16}}={S}{{0,16}}|{S}{{1,16}})({N}{{8,}})"
)
# tried once for each run of spaces, not at every space of it
_TRAILING_SPACE = rf"(?U)(?<!{S}){S}++$"


def is_dockerfile(name: Column) -> Column:
    return (name == "Dockerfile") | name.startswith("Dockerfile.") | name.endswith(".dockerfile")


def _stages(lines: Column, lows: Column) -> Column:
    """Declared stages as ``array<struct<name, at>>``, sorted by name, then line."""
    def name(line, low):
        return F.when(_has(low, "from") & _has(low, "as"), F.lower(F.regexp_extract(line, FROM, 2))).otherwise("")

    declared = F.transform(lines, lambda line, i: F.struct(name(line, F.get(lows, i)).alias("name"), i.alias("at")))
    return F.sort_array(F.filter(declared, lambda d: d["name"] != ""))


def _declared_before(stages: Column, name: Column, at: Column) -> Column:
    """Is ``name`` a stage of an earlier line? Binary search for the first entry that
    is not below (name, 0), so that a file of n stages costs n log n."""
    key = F.struct(name.alias("name"), F.lit(0).alias("at"))

    def halve(acc, _):
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        below = F.get(stages, middle) < key
        return F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(below, acc["high"]).otherwise(middle).alias("high"),
        ))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(stages) + 1)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("low"), F.size(stages).alias("high"))
    first = F.aggregate(steps, start, halve, lambda acc: F.get(stages, acc["low"]))
    return F.coalesce((first["name"] == name) & (first["at"] < at), F.lit(False))


def _unpinned(image: Column) -> Column:
    return (
        (image != "")
        & (F.lower(image) != "scratch")
        & (~F.contains(image, F.lit(":")) | image.endswith(":latest"))
    )


def _has(line: Column, *literals: str) -> Column:
    """Does the folded line hold one of the literals? A regex that needs one of them
    runs only then."""
    found = F.lit(False)
    for literal in literals:
        found = found | F.contains(line, F.lit(literal))
    return found


def _copy_would_do(line: Column) -> Column:
    source = F.regexp_extract(F.regexp_replace(line, _TRAILING_SPACE, ""), ADD, 1)

    def plain(src):
        special = src.startswith("http://") | src.startswith("https://")
        for suffix in rules.ADD_ARCHIVE_SUFFIXES:
            special = special | src.endswith(suffix)
        return (src != "") & ~special

    return let(source, plain)


def _line_hits(line: Column, low: Column, i: Column, stages: Column) -> Column:
    image = F.when(_has(low, "from"), F.regexp_extract(line, FROM, 1)).otherwise("")

    def report(condition, category, description, points=0):
        return condition, hit(f"dockerfile_{category}", description, line=i + 1, points=points)

    return hits_if(
        report(
            let(image, lambda name: _unpinned(name) & ~_declared_before(stages, F.lower(name), i)),
            "unpinned_base_image",
            F.concat(F.lit("Base image not pinned to a specific version: "), image),
        ),
        report(_has(low, "user") & line.rlike(USER_ROOT), "root_user", "Explicitly runs as root", rules.POINTS_ROOT_USER),
        report(_has(low, "add") & _copy_would_do(line), "add_vs_copy",
               "ADD used where COPY would suffice (no auto-extraction/URL fetch needed)"),
        report(_has(low, "curl", "wget") & line.rlike(PIPE_TO_SHELL), "pipe_to_shell",
               "Pipes a remote download directly into a shell", rules.POINTS_PIPE_TO_SHELL),
        report(_has(low, "curl", "--no-check-certificate") & line.rlike(INSECURE_TLS), "insecure_tls",
               "Disables TLS certificate verification", rules.POINTS_INSECURE_TLS),
        report(_has(low, "env", "arg") & _has(low, "password", "secret", "token", "api_key")
               & F.regexp_extract(line, ENV_ARG, 1).rlike(HARDCODED_SECRET), "hardcoded_secret",
               "Hardcoded credential in ENV/ARG instruction", rules.POINTS_HARDCODED_SECRET),
    )


def dockerfile(text: Column, name: Column) -> Column:
    """Findings in line order, then the missing USER. Scored ones are medium when the
    file's own points reach 20."""

    def scan(lines, lows):
        per_line = let(_stages(lines, lows), lambda stages: F.flatten(
            F.transform(lines, lambda line, i: let(F.get(lows, i), lambda low: _line_hits(line, low, i, stages)))
        ))
        with_user = F.filter(lines, lambda line, i: _has(F.get(lows, i), "user"))
        no_user = hits_if((
            ~F.exists(with_user, lambda line: line.rlike(USER)),
            hit("dockerfile_root_user", "No USER instruction: container runs as root by default",
                points=rules.POINTS_ROOT_USER),
        ))
        return F.concat(per_line, no_user)

    # no letter is folded by what stands on another line
    both = let(F.split(text, "\n"), lambda lines: let(F.split(fold(text), "\n"), lambda lows: scan(lines, lows)))
    hits = F.when(is_dockerfile(name), both)
    return to_findings("dockerfile", hits, dockerfile_severity)


def dockerfile_severity(hits: Column) -> Column:
    return F.when(total_points(hits) >= rules.DOCKER_MEDIUM_FROM, "medium").otherwise("low")
