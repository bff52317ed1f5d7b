"""Roll-up, ranking, reports."""

import csv
import io
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom import queries
from riskloom.functions import scoring as S
from riskloom.functions.findings import FINDINGS
from riskloom.operators.topk import top_k
from riskloom.plans import exports, reports, summary
from riskloom.plans.runs import run_scan
from riskloom.plans.scan import scan
from riskloom.sources import corpora
from riskloom.storage import shared_folder

RESULTS = f"repo_id string, path string, findings {FINDINGS}, risk_score double"


def finding(severity, category="c", description="d", line=None, points=0):
    return ("det", severity, category, description, None, line, points)


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([
        ("a", "z.py", [finding("low", "secret", "first", 3), finding("critical", "secret", "worse")], 100.0),
        ("a", "b.py", [finding("medium"), finding("info", "long_line", "long", 7)], 0.0),
        ("a", "c\\d.py", [], 25.0),
        ("b", "n.py", [finding("info", "network", f"n{i}") for i in range(60)] + [finding("critical", "secret")], 49.9),
        ("c", "ok.py", [], 9.9),
    ], RESULTS)


@pytest.fixture(scope="module")
def repos(results):
    rows = summary.verdicts(summary.repo_summary(results)).collect()
    return {r["repo_id"]: r for r in rows}


def test_counts_and_totals(repos):
    a, b, c = repos["a"], repos["b"], repos["c"]
    assert (a["total_files"], a["overall_risk_score"], a["risk_level"]) == (3, 100.0, "critical")
    assert [a[k] for k in ("high_risk_files", "medium_risk_files", "low_risk_files", "safe_files")] == [1, 1, 0, 1]
    assert (a["findings_count"], a["cautions_count"]) == (3, 1)
    assert (b["findings_count"], b["cautions_count"], b["findings_reported"], b["cautions_reported"]) == (1, 60, 1, 50)
    assert (c["findings"], c["cautions"], c["risk_level"]) == ([], [], "safe")


def test_findings_are_sorted_by_severity_then_path(repos):
    assert [f["severity"] for f in repos["a"]["findings"]] == ["critical", "medium", "low"]
    assert [f["description"] for f in repos["b"]["cautions"]][:3] == ["n0", "n1", "n2"]


def test_labels_and_gate(repos, spark):
    assert repos["a"]["threshold_exceeded"] and not repos["b"]["threshold_exceeded"]
    scores = spark.createDataFrame([(s,) for s in (0.0, 9.9, 10.0, 15.0, 25.0, 30.0, 50.0, 75.0, 150.0)], "s double")
    s = F.col("s")
    rows = scores.select(
        "s", S.band(s).alias("band"), S.status(s).alias("status"), S.recommendation(s).alias("advice"),
        S.exceeds(s, "high").alias("high"), S.exceeds(s, "none").alias("none"), S.score_bar(s, 10).alias("bar"),
    ).collect()
    by = {r["s"]: r for r in rows}
    assert [by[x]["band"] for x in (0.0, 9.9, 10.0, 25.0, 50.0, 75.0)] == ["safe", "safe", "low", "medium", "high", "critical"]
    assert by[15.0]["advice"] == "REVIEW BEFORE CLONING" and by[30.0]["advice"] == "EXERCISE CAUTION"
    assert by[75.0]["status"] == "CRITICAL"
    assert by[50.0]["high"] and not by[30.0]["high"] and not by[150.0]["none"]
    assert (by[9.9]["bar"], by[25.0]["bar"], by[150.0]["bar"]) == ("-" * 10, "##--------", "#" * 10)


def test_detailed_lines(results):
    rows = summary.detailed(results).collect()
    caution = [r for r in rows if r["repo_id"] == "b" and r["is_caution"]]
    assert len(caution) == 10 and {(r["shown"], r["total"]) for r in caution} == {(10, 60)}
    lines = {r["report_line"] for r in rows if r["repo_id"] == "a"}
    assert {"z.py:3 secret: first", "b.py:7 long_line: long", "z.py secret: worse"} <= lines


def test_long_descriptions_are_cut(spark):
    df = spark.createDataFrame([("x" * 60,), ("x" * 61,)], "d string")
    assert [r[0] for r in df.select(S.short_description(F.col("d"))).collect()] == ["x" * 60, "x" * 60 + "..."]


def test_top_k_of_a_hot_group_equals_brute_force(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 9)}", rng.randint(0, 40), i) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    got = top_k(df, ["g"], [F.col("v"), F.col("i")], 25, spread_by=["i"], salts=4).collect()
    want = set()
    for g in {d[0] for d in data}:
        for rank, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1:])[:25], start=1):
            want.add((*d, rank))
    assert {tuple(r) for r in got} == want


def test_sarif(repos, results):
    logs = {r["repo_id"]: json.loads(r["report"]) for r in reports.sarif_logs(summary.repo_summary(results)).collect()}
    log = logs["a"]
    assert log["version"] == "2.1.0" and "$schema" in log
    run = log["runs"][0]
    assert [(r["id"], r["defaultConfiguration"]["level"]) for r in run["tool"]["driver"]["rules"]] == [
        ("secret", "error"), ("c", "warning"), ("long_line", "note")]
    assert [r["level"] for r in run["results"]] == ["error", "warning", "note", "note"]
    physical = [r["locations"][0]["physicalLocation"] for r in run["results"]]
    assert "region" not in physical[0] and physical[2]["region"] == {"startLine": 3}
    assert logs["c"]["runs"][0]["results"] == []


def test_sarif_paths(spark):
    df = spark.createDataFrame([("/tmp/c1/src/a.py",), ("/etc/passwd",), ("repo\\sub\\a.py",), ("/tmp/c12/x",)], "p string")
    uris = [r[0] for r in df.select(reports.sarif_uri(F.col("p"), "/tmp/c1")).collect()]
    assert uris == ["src/a.py", "/etc/passwd", "repo/sub/a.py", "/tmp/c12/x"]


def test_repo_names(spark):
    names = {"https://example.com/me/my.github.io.git": "my.github.io", "https://example.com/me/repo": "repo",
             "https://example.com/me/repo.git/": "repo", "repo": "repo"}
    df = spark.createDataFrame([(u,) for u in names], "u string")
    assert {r[0]: r[1] for r in df.select("u", S.repo_name(F.col("u"))).collect()} == names


def document(path, repo):
    """The part files of a repository, put together in order of name."""
    return "".join(p.read_text() for p in sorted((path / f"repo_id={repo}").glob("part-*")))


def test_export(results, tmp_path):
    assert exports.export_reports(results, None) == []
    (tmp_path / "taken.csv").mkdir()
    paths = [str(tmp_path / n) for n in ("R.JSON", "r.txt", "taken.csv", "r.csv", "r.sarif")]
    done = exports.export_reports(results, paths, by_repo=True)
    assert [(e.path, e.format, e.state) for e in done] == list(zip(
        paths, ["json", "txt", "csv", "csv", "sarif"], ["written", "unsupported", "failed", "written", "written"], strict=True))
    assert [e.error is not None for e in done] == [False, False, True, False, False]
    assert [e.state for e in exports.export_reports(results, ["x.doc"])] == ["unsupported"]
    reports_ = {r: json.loads(document(tmp_path / "R.JSON", r)) for r in "abc"}
    assert reports_["a"]["findings"][0] == {
        "file": "z.py", "severity": "critical", "category": "secret", "description": "worse", "line": None}
    assert [f["severity"] for f in reports_["a"]["findings"]] == ["critical", "medium", "low"]
    assert reports_["b"]["findings_count"] == 1 and [c["description"] for c in reports_["b"]["cautions"]] == [f"n{i}" for i in range(60)]
    assert reports_["c"]["findings"] == reports_["c"]["cautions"] == [] and reports_["c"]["risk_level"] == "safe"
    rows = list(csv.reader(io.StringIO(document(tmp_path / "r.csv", "a"))))
    assert rows[0] == ["File", "Line", "Severity", "Category", "Description"] and len(rows) == 5
    assert len(document(tmp_path / "r.csv", "b").splitlines()) == 62
    run = json.loads(document(tmp_path / "r.sarif", "a"))["runs"][0]
    assert [(r["id"], r["defaultConfiguration"]["level"]) for r in run["tool"]["driver"]["rules"]] == [
        ("secret", "error"), ("c", "warning"), ("long_line", "note")]
    assert [r["level"] for r in run["results"]] == ["error", "warning", "note", "note"]
    assert "region" not in run["results"][0]["locations"][0]["physicalLocation"]


def test_export_of_odd_texts(spark, tmp_path):
    odd = [finding("info", "x", 'say "hi"\\ \n,'), finding("low", "y_z", "\u2028 \u00e9 \t")]
    results = spark.createDataFrame([("d/e f", ' a,"b ', odd, 9.0), ("same", "p", odd[:1], 1.0), ("same", "p", odd[:1], 1.0)], RESULTS)
    exports.export_all(results, str(tmp_path / "all"), by_repo=True, scan_root="/tmp")
    folder = lambda f: tmp_path / "all" / f"format={f}"
    report = json.loads(document(folder("json"), "d%2Fe f"))
    assert [f["description"] for f in report["findings"] + report["cautions"]] == ["\u2028 \u00e9 \t", 'say "hi"\\ \n,']
    rows = list(csv.DictReader(io.StringIO(document(folder("csv"), "d%2Fe f"), newline="")))
    assert rows[1]["File"] == ' a,"b ' and rows[1]["Description"] == 'say "hi"\\ \n,'
    log = json.loads(document(folder("sarif"), "d%2Fe f"))
    assert [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]] == ["y_z", "x"] and log["version"] == "2.1.0"
    # rows that repeat are entries of their own
    assert len(json.loads(document(folder("json"), "same"))["cautions"]) == 2


def test_a_repository_of_many_findings_is_split_and_whole(spark, tmp_path):
    many = spark.range(0, 1000, 1, 8).selectExpr("id", "'hot' as repo_id", "concat('f', lpad(id, 4, '0'), '.py') as path").select(
        "repo_id", "path", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(
            F.lit("det"), F.when(i % 3 == 0, "high").when(i % 3 == 1, "low").otherwise("info"), F.lit("c"),
            F.concat(F.lit("n "), F.col("id").cast("string"), F.lit(" "), i.cast("string")), F.lit(None), i, F.lit(1),
        )).cast(FINDINGS).alias("findings"), F.lit(50.0).alias("risk_score"))
    few = spark.createDataFrame([("cold", "a.py", [finding("low")], 3.0)], RESULTS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = exports.export_reports(many.unionByName(few), [str(tmp_path / n) for n in ("r.json", "r.csv", "r.sarif")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [e.state for e in done] == ["written"] * 3
    assert len(list((tmp_path / "r.json").glob("part-*"))) > 2
    whole = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    first, cold, report = whole("r.json").split("\x1e")
    cold, report = json.loads(cold), json.loads(report)
    assert not first and (cold["repo_name"], cold["findings_count"], report["repo_name"]) == ("cold", 1, "hot")
    assert (len(report["findings"]), len(report["cautions"])) == (67_000, 33_000)
    rank = {"high": 0, "low": 1}
    order = [(rank[f["severity"]], f["file"], f["line"]) for f in report["findings"]]
    assert order == sorted(order) and len(set(order)) == 67_000
    log = json.loads(whole("r.sarif").split("\x1e")[2])
    assert len(log["runs"][0]["results"]) == 100_000 and log["runs"][0]["automationDetails"] == {"id": "hot"}
    rows = list(csv.reader(io.StringIO(whole("r.csv"))))
    assert len(rows) == 100_002 and rows[0][:2] == ["Repository", "File"] and {r[0] for r in rows[1:]} == {"cold", "hot"}


def test_a_run_knows_its_time_and_losses(make_files):
    files = make_files(("r", "a.py", "eval(x)"), ("r", "b.py", "x", None, False), ("s", "c.py", None, 9, False), ("s", "yarn.lock", "x"))
    files = files.withColumn("read_error", F.when(F.col("path") == "c.py", F.lit("Permission denied")))
    run = run_scan(files)
    assert (run.listed, run.dropped, run.failed) == (4, 1, 1) and run.results.count() == 2
    rows = run.summary().collect()
    assert {r["repo_id"] for r in rows} == {"r", "s"} and 0 < run.seconds == rows[0]["scan_duration"]
    assert (rows[0]["scan_ended"] - rows[0]["scan_started"]).total_seconds() == pytest.approx(run.seconds, abs=1e-5)
    texts = reports.json_reports(run.summary(), scan_duration=F.col("scan_duration")).collect()
    assert {json.loads(r["report"])["scan_duration"] for r in texts} == {run.seconds}
    nothing = run_scan(files.limit(0))
    assert (nothing.listed, nothing.dropped, nothing.failed) == (0, 0, 0) and nothing.summary().count() == 0


def test_texts_of_reports_are_put_together_behind_the_sort(results, capsys):
    for formats in (exports.FORMATS, ("sarif",)):
        exports._sorted(results, formats, by_repo=True).explain()
        behind, sorted_ = capsys.readouterr().out.split("rangepartitioning", 1)
        assert "struct(ruleId" in behind and "struct(ruleId" not in sorted_


def test_reports_of_the_query_are_stored_compressed_and_whole(spark, tmp_path):
    spark.createDataFrame(
        [(i, f"eval(x{i})", "en", f"src{i % 2}") for i in range(12)], "doc_id long, text string, lang string, source string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    folders = Path(shared_folder(spark).removeprefix("file:")) / "riskloom" / spark.sparkContext.applicationId
    before = set(folders.glob("reports-*"))
    got = queries.export_files(spark, str(tmp_path)).drop("format")
    files = [f for folder in set(folders.glob("reports-*")) - before for f in folder.rglob("part-*")]
    assert files and all(f.name.endswith(".gz") for f in files)
    corpus = corpora.documents_with_payloads(spark, str(tmp_path)).unionByName(corpora.dockerfiles_from_orders(spark, str(tmp_path)))
    found = reports.export_rows(scan(corpus)).collect()
    want = Counter((r["repo_id"], r["File"], r["Line"], r["Category"], r["Description"]) for r in found)
    rows = Counter((r["repo_id"], r["file"], r["line"], r["category"], r["description"]) for r in got.collect())
    assert want and rows == Counter({row: 3 * n for row, n in want.items()})
