"""Hostile input must neither hang nor crash a task."""

import json
import random
import time

from riskloom.functions.lines import first_lines
from riskloom.operators import dependencies as deps
from riskloom.operators.paths import ignore_lists
from riskloom.plans.scan import analyze
from pyspark.sql import functions as F

TEXTS = {
    "get.txt": "requests.get" * 20_000,
    "urllib.txt": "urllib" * 40_000,
    "jwt.txt": "eyJ" * 60_000,
    "base64.txt": ("A" * 39 + " ") * 5_000,
    "keys.txt": ("AKIA" + "QRSTUVWX01234567" + "\n") * 3_000,
    "a/Dockerfile": "FROM python:3.12\nUSER app\nENV " + "A" * 200_000 + "\n",
    "b/Dockerfile": "FROM python:3.12\nUSER app\nENV PASSWORD" + " " * 100_000 + "\n",
    "c/Dockerfile": "FROM python:3.12\nUSER app\nRUN " + "curl " * 20_000 + "\n",
    "d/Dockerfile": "FROM python:3.12\nUSER app\nADD " + "--a " * 50_000 + "x /\n",
    "f/Dockerfile": "FROM python:3.12\nUSER app\nRUN a" + " " * 1_000_000 + "b\n",
    "g/Dockerfile": "FROM python:3.12\nUSER app\nADD a" + " " * 1_000_000 + "b\n",
    "h/Dockerfile": "FROM python:3.12\nUSER app\nRUN curl" + " " * 1_000_000 + "b\n",
    ".reposecurityignore": "a" + " " * 1_000_000 + "b\n",
    "e/Dockerfile": "".join(f"FROM s{i} AS s{i + 1}\n" for i in range(3_000)),
}


def test_hostile_texts(make_files):
    analyze(make_files(("r", "warm.py", "x"))).collect()
    rows = {}
    for path, text in TEXTS.items():
        files = make_files(("r", path, text))
        start = time.perf_counter()
        rows[path] = analyze(files).collect()[0]
        globs = ignore_lists(files).collect()
        assert time.perf_counter() - start < 5, path
        assert len(globs) == (path == ".reposecurityignore")
    assert len([f for f in rows["keys.txt"]["findings"] if f["category"] == "secret"]) == 3_000
    unpinned = [f["line"] for f in rows["e/Dockerfile"]["findings"] if f["category"].endswith("base_image")]
    assert unpinned == [1]
    assert [f["line"] for f in rows["d/Dockerfile"]["findings"] if f["category"].endswith("add_vs_copy")] == [3]


def test_manifests_of_many_pins_are_linear(spark, make_files):
    pins = {f"package-{i}": f"1.{i}.0" for i in range(20_000)}
    npm = json.dumps({"name": "x", "dependencies": pins | {"axios": "0.1.0"}}, indent=1)
    pip = "\n".join([f"{name}=={version}" for name, version in pins.items()] + ["requests==1.0"])
    files = make_files(("npm", "package.json", npm), ("pip", "requirements.txt", pip))
    deps.manifests(files.limit(0)).count()  # started workers
    start = time.perf_counter()
    rows = {r["repo_id"]: r for r in deps.manifests(files).select("repo_id", "floor_hits", F.size("pins").alias("n"), F.element_at("pins.line", -2).alias("line")).collect()}
    assert time.perf_counter() - start < 5
    assert rows["npm"]["n"] == rows["pip"]["n"] == 20_001
    assert [rows[r]["floor_hits"][0]["finding"]["line"] for r in ("npm", "pip")] == [20_004, 20_001]
    assert rows["npm"]["line"] == 20_003 and rows["pip"]["line"] == 20_000


def test_first_lines_equal_a_plain_search():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice('ab""\n:') for _ in range(rng.randint(0, 40)))
        names = ["".join(rng.choice('ab\n"') for _ in range(rng.randint(0, 2))) for _ in range(6)] + ["a", "a"]
        want = [text.count("\n", 0, at) + 1 if (at := text.find(f'"{n}"')) >= 0 else None for n in names]
        assert first_lines(text, names) == want
    assert first_lines(None, ["a"]) is None and first_lines("a", None) is None and first_lines("", []) == []
