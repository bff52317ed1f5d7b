"""Container build files; all cases in one job."""

import pytest

from riskloom.plans.scan import analyze

BASE = "FROM python:3.12-slim\nUSER app\n"
CASES = {
    "hygiene": "FROM python:latest\nUSER app\nADD app.py /app/\n",
    "pinned": BASE,
    "no_user": "FROM python:3.12-slim\nCMD [\"python\", \"app.py\"]\n",
    "root": "FROM python:3.12-slim\nUSER root\n",
    "uid0": "FROM python:3.12-slim\nUSER 0\n",
    "uid0_gid": "FROM python:3.12-slim\nUSER 0:0\n",
    "uid1000": "FROM python:3.12-slim\nUSER 1000\n",
    "add_url": BASE + "ADD https://example.com/f.bin /app/\n",
    "add_flag_url": BASE + "ADD --chown=app:app https://example.com/f.bin /app/\n",
    "add_archive": BASE + "ADD pkg.tar.gz /opt/\n",
    "add_only_flags": BASE + "ADD --a --b  \n",
    "pipe": BASE + "RUN curl https://get.example.com | bash\n",
    "pipe_word": BASE + "RUN curl https://get.example.com | shellcheck\n",
    "tls": BASE + "RUN curl -k https://example.com\n",
    "tls_word": BASE + "RUN curl -key https://example.com\n",
    "env": BASE + "ENV DB_PASSWORD=supersecret123\n",
    "env_second": BASE + "ENV FOO=bar DB_PASSWORD=supersecret123\n",
    "env_short": BASE + "ENV DB_PASSWORD=x\n",
    "stage": "FROM python:3.12-slim AS Builder\nRUN pip install .\nFROM builder\nUSER app\n",
    "stage_later": "FROM builder\nFROM a:1 AS builder\nFROM builder AS builder\nFROM BUILDER\nUSER app\n",
    "stage_same_line": "FROM x AS x\nUSER app\n",
    "platform": "FROM --platform=linux/amd64 alpine\nUSER app\n",
    "two_points": "FROM a:1\nUSER root\nUSER root\n",
}


@pytest.fixture(scope="module")
def results(make_files):
    rows = analyze(make_files(*[("r", f"{case}/Dockerfile", text) for case, text in CASES.items()])).collect()
    return {row["path"].split("/")[0]: row for row in rows}


def hits(results, case):
    return [
        (f["category"].removeprefix("dockerfile_"), f["line"])
        for f in results[case]["findings"] if f["detector"] == "dockerfile"
    ]


EXPECTED = {
    "hygiene": [("unpinned_base_image", 1), ("add_vs_copy", 3)],
    "pinned": [],
    "no_user": [("root_user", None)],
    "root": [("root_user", 2)],
    "uid0": [("root_user", 2)],
    "uid0_gid": [("root_user", 2)],
    "uid1000": [],
    "add_url": [],
    "add_flag_url": [],
    "add_archive": [],
    "add_only_flags": [("add_vs_copy", 3)],
    "pipe": [("pipe_to_shell", 3)],
    "pipe_word": [],
    "tls": [("insecure_tls", 3)],
    "tls_word": [],
    "env": [("hardcoded_secret", 3)],
    "env_second": [("hardcoded_secret", 3)],
    "env_short": [],
    "stage": [],
    "stage_later": [("unpinned_base_image", 1)],
    "stage_same_line": [("unpinned_base_image", 1)],
    "platform": [("unpinned_base_image", 1)],
    "two_points": [("root_user", 2), ("root_user", 3)],
}


@pytest.mark.parametrize("case", EXPECTED)
def test_checks(results, case):
    assert hits(results, case) == EXPECTED[case]


def test_scores_and_severities(results):
    assert results["hygiene"]["risk_score"] == 0.0
    assert results["root"]["risk_score"] == 10.0
    assert {f["severity"] for f in results["root"]["findings"]} == {"low"}
    assert {f["severity"] for f in results["two_points"]["findings"]} == {"medium"}
    assert results["env"]["risk_score"] == 15.0


def test_folded_letters_of_instructions(make_files):
    texts = {
        "folded": "FROM x:1 A\u017f Ba\u017fe\nFROM ba\u017fe\nU\u017fER app\nENV TO\u212aEN=abcdefgh1\nLABEL a=\u03a3\nENV A\u0130=\u0131\n",
        "plain": "FROM x:1 AS Base\nFROM base\nUSER app\nENV TOKEN=abcdefgh1\nLABEL a=S\nENV AI=i\n",
    }
    got = {r["path"]: [(f["category"], f["line"]) for f in r["findings"] if f["detector"] == "dockerfile"]
           for r in analyze(make_files(*[("r", f"{name}.dockerfile", text) for name, text in texts.items()])).collect()}
    assert got["plain.dockerfile"] == [("dockerfile_hardcoded_secret", 4)]
    assert ("dockerfile_hardcoded_secret", 4) in got["folded.dockerfile"]
    assert not [c for c in got["folded.dockerfile"] if c[0] == "dockerfile_root_user"]
