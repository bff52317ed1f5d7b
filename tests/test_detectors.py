"""Detector behaviour on single texts. All texts are scanned in one job."""

import pytest

from riskloom.plans.scan import analyze

LONG = "x" * 510
KEY = "AKIA" + "QRSTUVWX01234567"
JWT = "eyJ" + "hbGciOiJIUzI1" + ".eyJzdWIiOiIxMjM0" + ".SflKxwRJSMeKKF2QT4"

TEXTS = {
    "backdoor.txt": "clean line\nanother clean line\nos.system(\"id\")\n",
    "clean.py": "def add(a, b):\n    return a + b\n",
    "near.txt": "requests.get(u); requests.post(u, data=d)",
    "far.txt": "telegram" + "x" * 500 + "bot",
    "newline_gap.txt": "telegram\nbot",
    "kelvin.txt": "ﬁ smtplıb ſtratum cryptonight",
    "many.txt": "xmrig stratum minerd cgminer ethminer",
    "four.txt": "xmrig stratum cgminer mining",
    "long.txt": LONG,
    "longer.txt": "x" * 1010,
    "second.txt": "short\n" + LONG + "\n",
    "limits.txt": "a" * 500 + "\n" + "b" * 501 + "\n" + "c" * 1000 + "\n" + "d" * 1001,
    "wide.txt": "\U0001f600" * 501,
    "source.sh": "echo hi\nsource ./env.sh\n",
    "version.sh": "# version 1.2.3\necho hi\n",
    "substring.py": "medieval",
    "upper.PY": "EVAL(x)\neval(x)",
    "unmapped.rb": "eval(x)",
    "sha.txt": "commit " + "a1b2c3d4" * 5,
    "decode.txt": "x = 1\nbase64.b64decode(payload)\n",
    "decode_long_s.txt": "baſe64.b64decode(payload)",
    "net.txt": "import requests\nrequests.get(url)\n",
    "key.txt": f"a\nkey = {KEY}\n",
    "same_line.txt": f"{KEY} {KEY}\n{KEY}",
    "placeholder.txt": "password = 'changeme123'\nkey = " + "AKIA" + "EXAMPLE012345678",
    "token_twice.txt": "token = '" + "ghp_" + "q" * 36 + "'",
    "across.txt": "x\nsecret =\n\n  '" + "m4n5b6v7c8x9z0a1s2d3f4" + "'\npassword: \"hunter2hunter2\"",
    "nbsp.txt": "password = 'hunter2hunter2'",
    "jwt.txt": f"a {JWT} b.{JWT}",
    "jwt_short.txt": "eyJ" + "hbGciOi" + ".eyJzdWIiOiIxMjM0" + ".SflKxwRJSMeKKF2QT4",
}


@pytest.fixture(scope="module")
def results(make_files):
    rows = analyze(make_files(*[("r", path, text) for path, text in TEXTS.items()])).collect()
    return {row["path"]: row for row in rows}


def found(results, path, category=None):
    return [f for f in results[path]["findings"] if category in (None, f["category"])]


def test_pattern_reports_first_line(results):
    hits = found(results, "backdoor.txt", "backdoor")
    assert [(h["line"], h["pattern"], h["points"], h["severity"]) for h in hits] == [(3, r"os\.system", 5, "low")]
    # the same call also matches the shell pattern: kept as two findings
    assert [h["pattern"] for h in found(results, "backdoor.txt", "shell_commands")] == [r"system\("]


def test_clean_text_has_no_findings(results):
    assert found(results, "clean.py") == [] and results["clean.py"]["risk_score"] == 0.0


def test_gaps_are_bounded_and_stay_on_the_line(results):
    assert found(results, "near.txt", "data_exfiltration")
    assert found(results, "far.txt", "data_exfiltration") == []
    assert found(results, "newline_gap.txt", "data_exfiltration") == []


def test_case_folding_knows_the_four_special_letters(results):
    assert [h["pattern"] for h in found(results, "kelvin.txt")] == ["cryptonight", "stratum", "smtplib"]


def test_severity_rises_above_twenty_points(results):
    assert {h["severity"] for h in found(results, "many.txt")} == {"medium"}
    assert results["many.txt"]["risk_score"] == 25.0
    assert {h["severity"] for h in found(results, "four.txt")} == {"low"}
    assert results["four.txt"]["risk_score"] == 20.0


def test_long_lines_are_unscored_cautions(results):
    (hit,) = found(results, "long.txt")
    assert (hit["category"], hit["severity"], hit["line"]) == ("long_line", "info", 1)
    assert results["long.txt"]["risk_score"] == 0.0
    assert found(results, "longer.txt")[0]["description"] == "extremely long line: 1010 chars"
    assert found(results, "second.txt")[0]["line"] == 2
    assert [h["description"] for h in found(results, "limits.txt")] == [
        "long line: 501 chars", "long line: 1000 chars", "extremely long line: 1001 chars"]
    assert found(results, "wide.txt")[0]["description"] == "long line: 501 chars"


def test_functions_are_case_sensitive_substrings_by_language(results):
    assert [(h["description"], h["line"]) for h in found(results, "source.sh")] == [("Dangerous function: source", 2)]
    assert found(results, "version.sh") == []
    assert [h["description"] for h in found(results, "substring.py", "dangerous_function")] == ["Dangerous function: eval"]
    assert [h["line"] for h in found(results, "upper.PY", "dangerous_function")] == [2]
    assert found(results, "unmapped.rb", "dangerous_function") == []


def test_base64(results):
    assert found(results, "sha.txt", "encoding") == []
    (hit,) = found(results, "decode.txt", "encoding")
    assert (hit["line"], hit["points"]) == (2, 10)
    # lower-casing, unlike matching without case, keeps the long s
    assert found(results, "decode_long_s.txt", "encoding") == []
    assert found(results, "decode_long_s.txt", "backdoor")


def test_network_is_a_caution(results):
    (hit,) = found(results, "net.txt", "network")
    assert (hit["description"], hit["line"], hit["severity"], hit["points"]) == ("HTTP request", 2, "info", 0)


def test_secrets(results):
    (hit,) = found(results, "key.txt", "secret")
    assert hit["description"] == "AWS Access Key ID detected: AKIA" + "*" * 16
    assert (hit["line"], hit["severity"], hit["points"]) == (2, "critical", 80)
    assert [h["line"] for h in found(results, "same_line.txt", "secret")] == [1, 2]
    assert results["same_line.txt"]["risk_score"] == 100.0
    assert found(results, "placeholder.txt", "secret") == []
    assert [h["description"].split(" detected")[0] for h in found(results, "token_twice.txt", "secret")] == ["GitHub Token"]
    assert [h["line"] for h in found(results, "across.txt", "secret")] == [2, 5]
    assert len(found(results, "nbsp.txt", "secret")) == 1
    assert len(found(results, "jwt.txt", "secret")) == 1  # the same value, on one line
    assert found(results, "jwt_short.txt", "secret") == []
