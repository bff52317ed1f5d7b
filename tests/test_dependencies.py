"""Manifest parsing, floors, advisories."""

import json
from dataclasses import replace

import pytest

from riskloom.operators import dependencies as deps
from riskloom.operators.joins import join_measured
from riskloom.plans import reports, summary
from riskloom.plans.scan import scan

PIP = {
    "old": ("requests==2.20.0\n", ["requests"]),
    "good": ("requests==2.31.0\n", []),
    "unpinned": ("requests\n", []),
    "unlisted": ("flask==0.1\n", []),
    "short": ("requests==2.31\n", ["requests"]),
    "extras": ("requests[security]==2.0.0\nrequests == 2.0.0\n", []),
    "case": ("  PyYAML==5.3.1 ; python_version > '3'\r\n", ["pyyaml"]),
    "bytes": (b"# caf\xe9\nrequests==2.0.0\n", ["requests"]),
    "bad_version": ("requests==2.0.\n", []),
    "twice": ("requests==2.0\n\n#x\nrequests==1.0\n", ["requests", "requests"]),
}
NPM = {
    "caret": ({"axios": "^0.21.1"}, ["axios"]),
    "fixed": ({"axios": "^0.21.2"}, []),
    "range": ({"axios": ">=0.20.0 <1.0.0", "lodash": "latest"}, []),
    "prefixes": ({"lodash": "~^=4.17.20", "request": "2.88.2"}, ["lodash", "request"]),
}


@pytest.fixture(scope="module")
def floors(make_files):
    rows = [(f"pip_{k}", "requirements.txt", text) for k, (text, _) in PIP.items()]
    rows += [(f"npm_{k}", "package.json", json.dumps({"dependencies": d}, indent=1)) for k, (d, _) in NPM.items()]
    rows += [("npm_broken", "package.json", "{not json"), ("npm_list", "package.json", "[]"),
             ("npm_none", "package.json", "{\"name\": \"axios\"}")]
    out = {}
    for r in deps.floor_rows(deps.manifests(make_files(*rows))).collect():
        out.setdefault(r["repo_id"], []).append(r)
    return out


@pytest.mark.parametrize("case", PIP)
def test_pip(floors, case):
    names = [r["finding"]["description"].split("'")[1] for r in floors.get(f"pip_{case}", [])]
    assert names == PIP[case][1]


@pytest.mark.parametrize("case", NPM)
def test_npm(floors, case):
    names = [r["finding"]["description"].split("'")[1] for r in floors.get(f"npm_{case}", [])]
    assert names == NPM[case][1]


def test_texts_and_lines(floors):
    (row,) = floors["pip_old"]
    assert row["finding"]["description"] == (
        "Python package 'requests' pinned to 2.20.0: SSL/TLS vulnerabilities in older versions (fixed in 2.31.0)")
    assert [r["finding"]["line"] for r in floors["pip_twice"]] == [1, 4]
    assert [r["finding"]["line"] for r in floors["npm_prefixes"]] == [3, 4]
    assert not {"npm_broken", "npm_list", "npm_none"} & set(floors)


@pytest.fixture(scope="module")
def advisories(spark):
    return spark.createDataFrame(
        [
            ("PyPI", "flask", [0], [1, 0], "A-1", "first", "d"),
            ("PyPI", "flask", None, [0, 5], "A-2", "", "x" * 200),
            ("PyPI", "flask", [2], None, "A-3", None, None),
            ("npm", "flask", None, None, "A-4", "other ecosystem", None),
            ("npm", "vue", None, None, None, None, ""),
        ],
        "ecosystem string, package string, introduced array<bigint>, fixed array<bigint>, "
        "id string, summary string, details string",
    )


def test_advisories(make_files, advisories):
    parsed = deps.manifests(make_files(
        ("r", "requirements.txt", "flask==0.1\nrequests==1.0\nflask\n"), ("s", "package.json", '{"dependencies": {"vue": "^3.0.0"}}'),
    ))
    rows = {r["repo_id"]: r for r in deps.dependency_results(parsed, advisories).collect()}
    assert [f["description"] for f in rows["r"]["findings"]] == [
        "PyPI package 'flask' 0.1: A-1 - first",
        "PyPI package 'flask' 0.1: A-2 - " + "x" * 120,
        "Python package 'requests' pinned to 1.0: SSL/TLS vulnerabilities in older versions (fixed in 2.31.0)",
    ]
    assert [(f["severity"], f["points"], f["line"]) for f in rows["r"]["findings"]] == [
        ("high", 20, 1), ("high", 20, 1), ("medium", 15, 2)]
    assert rows["s"]["findings"][0]["description"] == "npm package 'vue' 3.0.0: unknown - no summary available"


def test_every_pin_of_a_long_manifest_is_looked_up(make_files, advisories):
    lines = ["# head"] + [f"p{i}==1.0" for i in range(49)] + ["flask", "flask==0.1", "flask==0.2"]
    parsed = deps.manifests(make_files(("r", "requirements.txt", "\n".join(lines))))
    found = deps.advisory_rows(parsed, advisories).collect()
    assert {r["finding"]["line"] for r in found} == {52, 53}


def test_npm_takes_strict_json_only(make_files):
    good = '{"dependencies": {"axios": "0.1.0"}}'
    bad = [good.replace('"', "'"), good + " trailing", good + good, good + "]", "[" + good + "]", good[:-1], ""]
    files = make_files(("good", "package.json", " \n" + good + "\n"), *((f"bad{i}", "package.json", t) for i, t in enumerate(bad)))
    assert {r["repo_id"] for r in deps.dependency_results(deps.manifests(files)).collect()} == {"good"}


def test_salted_join_equals_broadcast_join(spark):
    big = spark.range(0, 2000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) as k", "id")
    small = spark.range(0, 60).selectExpr("if(id < 5, 'hot', concat('k', id)) as k", "id as other")
    for how in ("inner", "left"):
        broadcast = join_measured(big, small, ["k"], how, spread_by=["id"])
        salted = join_measured(big, small, ["k"], how, spread_by=["id"], max_bytes=0, salts=4)
        assert sorted(map(str, broadcast.collect())) == sorted(map(str, salted.collect()))
        assert broadcast.columns == salted.columns


def many_advisories(spark, n, package="flask"):
    return spark.range(n).selectExpr(
        "'PyPI' as ecosystem", f"'{package}' as package", "cast(null as array<bigint>) as introduced", "array(9L) as fixed",
        "concat('A-', lpad(id, 4, '0')) as id", "concat('text ', id) as summary", "'' as details",
    )


def test_findings_are_stored_by_pin_not_by_advisory(spark, make_files):
    files = make_files(*((f"r{i}", "requirements.txt", "flask==0.1\nrequests==1.0\n") for i in range(40)))
    found = deps.dependency_results(deps.manifests(files), many_advisories(spark, 300))
    short = deps.advised(found)
    assert short.rows.selectExpr("sum(size(parts))").first()[0] == 80
    assert short.groups.selectExpr("sum(size(listed))").first()[0] == 300
    assert {tuple(r) for r in deps.dependency_scores(found).select("risk_score", "n_findings").collect()} == {(100.0, 301)}
    assert found.selectExpr("sum(size(findings))").first()[0] == 40 * 301
    assert short.findings().count() == 40 * 301 and short.findings(k=5).count() == 40 * 6
    assert short.findings(of_each=1).count() == 80


def test_short_and_whole_findings_agree(spark, make_files):
    """A manifest that comes twice, so that places repeat, and an advisory without a name."""
    names = spark.createDataFrame(
        [("PyPI", "flask", None, [9], "", "no name", "")],
        "ecosystem string, package string, introduced array<bigint>, fixed array<bigint>, id string, summary string, details string",
    )
    advisories = many_advisories(spark, 3).union(many_advisories(spark, 2, "requests")).union(names)
    text = "requests==1.0\nflask==0.1\n"
    files = make_files(
        ("r", "requirements.txt", text), ("r", "requirements.txt", "flask==0.1\nrequests==1.0\n"), ("s", "requirements.txt", text),
        (None, "requirements.txt", text), ("r", "package.json", '{"dependencies": {"axios": "0.1.0"}}'),
    )
    found = deps.dependency_results(deps.manifests(files), advisories)
    whole = {r["repo_id"]: [f["description"].split(": ")[-1].split(" - ")[0][:8] for f in r["findings"]] for r in found.collect()}
    floor = "SSL/TLS "
    assert whole["s"] == whole[None] == [floor, "A-0000", "A-0001", "", "A-0000", "A-0001", "A-0002"]
    assert len(whole["r"]) == 15
    own = deps.advisory_rows(deps.manifests(files), advisories).where("repo_id = 'r'").collect()
    ordered = sorted((r["ord"], r["advisory"], r["finding"]["description"]) for r in own)
    advised = [f["description"] for f in found.where("repo_id = 'r'").first()["findings"] if f["detector"] == "advisory"]
    assert advised == [d for _, _, d in ordered]
    rows = summary.finding_rows(scan(files, advisories=advisories)).where("path = 'dependencies' and repo_id = 'r'")
    listed = [r["description"] for r in rows.orderBy("ord").collect()]
    assert listed == [f["description"] for f in found.where("repo_id = 'r'").first()["findings"]]
    assert [r["ord"] for r in rows.orderBy("ord").collect()] == list(range(15))


def test_summaries_read_the_short_form(spark, make_files):
    files = make_files(("r", "requirements.txt", "requests==1.0\nflask==0.1\n"), ("r", "a.py", "eval(x)"))
    results = scan(files, advisories=many_advisories(spark, 80))
    plain = results.select("*")  # another table of the same rows
    assert deps.advised(results) and not deps.advised(plain)
    same = lambda f: sorted(map(str, f(results).collect())) == sorted(map(str, f(plain).collect()))
    assert same(summary.rollup) and same(summary.repo_summary) and same(summary.detailed)
    assert same(summary.finding_rows) and same(reports.rule_rows)


def test_ranked_lists_move_pins_and_not_their_texts(spark, make_files, capsys):
    """F7, F8, F9, F11: a row for each pin is ranked, its texts are made where they are listed."""
    files = make_files(*((f"r{i}", "requirements.txt", "flask==0.1\nrequests==1.0\n") for i in range(40)))
    results = scan(files, advisories=many_advisories(spark, 300))
    ranked = summary._ranked(results, 50)
    assert ranked.count() == 40 and ranked.selectExpr("sum(taken)").first()[0] == 40 * 50
    capsys.readouterr()
    summary.ranked_lists(results).explain()
    plan = capsys.readouterr().out
    # the texts come by a broadcast of the lists, and nothing is shuffled above them
    above = plan[:plan.index("BroadcastHashJoin")]
    assert "package '" in above and "Exchange" not in above
    listed = summary.repo_summary(results).collect()
    assert {(r["findings_reported"], len(r["findings"]), r["findings_count"]) for r in listed} == {(50, 50, 301)}


def test_files_named_like_the_dependencies_stand_among_them(spark):
    high = lambda name: ("det", "high", "c", name, None, None, 9)
    parsed = deps.with_dependencies(spark.createDataFrame(
        [(r, "requirements.txt", "requests==1.0\nflask==0.1\nflask==0.2\n") for r in ("r", "s")],
        "repo_id string, path string, manifest_text string",
    ))
    short = deps.advised(deps.dependency_results(parsed, many_advisories(spark, 30)))
    files = spark.createDataFrame(
        [("r", "dependencies", [high(f"f{i}") for i in range(70)], 100.0), ("r", "e", [high("e")], 9.0),
         ("s", "a", [high("a")], 9.0), ("s", "z", [high("z")], 9.0)],
        "repo_id string, path string, findings array<struct<detector:string,severity:string,category:string,"
        "description:string,pattern:string,line:int,points:int>>, risk_score double",
    )
    results = deps.with_advised(files.select("*"), replace(short, files=files))
    for k in (1, 7, 40, 75):
        for repo in "rs":
            got = summary.ranked_findings(results, k).where(f"repo_id = '{repo}' and not is_caution").orderBy("rank").collect()
            every = summary.finding_rows(results).where(f"repo_id = '{repo}' and severity = 'high'").collect()
            places = sorted((r["path"], r["ord"]) for r in every)[:k]
            assert [(r["path"], r["ord"]) for r in got if r["severity"] == "high"] == places
            assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
            text = {(r["path"], r["ord"], r["description"]) for r in every}
            assert all((r["path"], r["ord"], r["description"]) in text for r in got if r["severity"] == "high")
