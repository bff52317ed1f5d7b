"""Decoding, classification, path filters, ignore rules."""

import fnmatch
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import text as T
from riskloom.functions import entropy as E
from riskloom.functions.entropy import byte_entropy
from riskloom.functions.globs import globs_to_regex
from riskloom.functions.versions import parse_version
from riskloom.operators import paths
from riskloom.operators.paths import ignore_lists, select_files
from riskloom.plans.scan import analyze, prepare, scan
from riskloom.sources.tables import store_files


def test_decoding_equals_python_ignore(make_files):
    rng = random.Random(7)
    parts = [b"a", b"\x1a", b"\x1a0", b"\x1a1", "é".encode(), "�".encode(), "\U0001f600".encode(),
             b"\xe2", b"\xe2\x82", b"\xf0\x9f", b"\xff", b"\xc0\xaf", b"\xed\xa0\x80", b"\x80", b"1", b"0"]
    contents = [b"".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(600)]
    df = make_files(*[("r", str(i), c) for i, c in enumerate(contents)])
    got = {r["path"]: r["t"] for r in df.select("path", T.decode_utf8(F.col("content")).alias("t")).collect()}
    assert got == {str(i): c.decode("utf-8", "ignore") for i, c in enumerate(contents)}


CONTENTS = {
    "utf8": ("hello wörld".encode(), "hello wörld"),
    "utf16le": ("hello".encode("utf-16"), "hello"),
    "utf16be": (b"\xfe\xff" + "pässword".encode("utf-16-be"), "pässword"),
    "utf16bad": (b"\xff\xfe" + b"\x00\xd8a\x00", None),
    "nul": (b"\x00\x01\x02random binary", None),
    "empty": (b"", ""),
    "latin": (b"caf\xe9 ol", None),
    "latin_late": (b"x" * 1024 + b"\xe9!", "x" * 1024 + "!"),
    "cut_char": (b"x" * 1023 + "é".encode() + b"y", "x" * 1023 + "éy"),
    "cut_bad": (b"x" * 1023 + b"\xc3y", None),
    "returns": (b"a\r\nb\rc\n", "a\nb\nc\n"),
}


def test_binary_test_and_text(make_files):
    rows = prepare(make_files(*[("r", name, c) for name, (c, _) in CONTENTS.items()])).collect()
    assert {r["path"]: r["text"] for r in rows} == {name: text for name, (_, text) in CONTENTS.items()}
    assert all(r["is_binary"] == (r["text"] is None) for r in rows)


def test_utf16_files_are_scanned_like_others(make_files):
    runs = "\n".join("QWxhZGRpbjpvcGVuIHNlc2FtZQb3JlbSBpcHN1bSBkb2xvciBzaXQg"[i:] + "abcdefgh"[: i + 4] for i in range(0, 4))
    text = "os.system('x')\n" + "".join(chr(65 + i % 26) + chr(97 + i % 23) + str(i % 10) for i in range(16)) + "\n" + runs
    rows = analyze(make_files(("r", "a.txt", text.encode()), ("r", "b.txt", text.encode("utf-16")))).collect()
    plain, wide = sorted(rows, key=lambda r: r["path"])
    drop = [f for f in wide["findings"] if f["detector"] != "entropy"]
    assert drop == plain["findings"] and drop


def test_entropy(make_files):
    assert byte_entropy(b"") == 0.0 and byte_entropy(b"aaaaaaaa") == 0.0
    assert byte_entropy(bytes(range(256))) == 8.0
    noise = random.Random(1).randbytes(5000)
    rows = {r["path"]: r for r in analyze(make_files(
        ("r", "noise.bin", noise), ("r", "short.bin", noise[:150]), ("r", "text.txt", "abc" * 500),
    )).collect()}
    (hit,) = rows["noise.bin"]["findings"]
    assert hit["category"] == "obfuscation" and hit["severity"] == "medium"
    assert hit["description"] == f"High entropy: {byte_entropy(noise):.2f} (possible obfuscation)"
    assert rows["noise.bin"]["risk_score"] == 20.0 and rows["noise.bin"]["is_binary"]
    assert rows["short.bin"]["findings"] == [] and abs(rows["text.txt"]["entropy"] - 1.584963) < 1e-6
    some = analyze(make_files(("r", "text.txt", "abc" * 500)), entropy_of="candidates").first()
    assert some["entropy"] is None


def test_size_cap(make_files):
    big = rules.MAX_FILE_BYTES
    files = make_files(
        ("r", "big.py", b"os.system(x)", big + 1, False), ("r", "fits.py", b"os.system(x)", big, False),
        ("r", "unreadable", None, 5, False), ("r", "gone", None, None, False),
    )
    whole = {r["path"]: r for r in analyze(files).collect()}
    assert whole["big.py"]["risk_score"] == whole["fits.py"]["risk_score"] > 0
    assert [f["category"] for f in whole["big.py"]["findings"]].count("size") == 1
    rows = {r["path"]: r for r in analyze(files, max_bytes=big).collect()}
    (hit,) = rows["big.py"]["findings"]
    assert (hit["category"], hit["severity"], hit["points"]) == ("size", "info", 0)
    assert rows["big.py"]["risk_score"] == 0.0 and rows["fits.py"]["risk_score"] > 0
    assert rows["unreadable"]["is_binary"] and rows["unreadable"]["findings"] == []
    assert "gone" not in rows


def test_read_errors_become_cautions(make_files):
    files = make_files(("r", "a", None, 5, False)).withColumn("read_error", F.lit("Permission denied"))
    (row,) = analyze(files).collect()
    assert [(f["severity"], f["description"]) for f in row["findings"]] == [
        ("info", "Error reading file: Permission denied")]


PATHS = {
    "src/a.py": True, "node_modules/a.py": False, "a/b/.git/config": False, "build": True,
    "x/build/y.py": False, "logo.PNG": False, "yarn.lock": False, "sub/go.sum": False,
    "lib.min.js": False, "lib.MIN.js": True, "a.min.css": False, ".env": True, "archive.tar.gz": False,
    ".png": True, "Go.sum": True,
}


def test_path_filters(make_files):
    rows = [("r", p, b"x") for p in PATHS]
    files = make_files(*rows, ("r", "link.py", b"x", 1, True), ("r", "big.py", b"", 2_000_000, False))
    kept = {r["path"] for r in files.filter(paths.wanted()).collect()}
    assert kept == {p for p, keep in PATHS.items() if keep} | {"big.py"}
    assert {r["path"] for r in files.filter(paths.wanted("quick")).collect()} == kept - {"big.py"}
    with pytest.raises(ValueError):
        paths.wanted("fast")


def test_file_types(make_files):
    names = {"a.py": ".py", "b/c.PY": ".PY", "Makefile": "unknown", ".bashrc": "unknown",
             "x.tar.gz": ".gz", "dot.": "unknown", ".a.b": ".b"}
    df = make_files(*[("r", n, b"") for n in names])
    rows = df.select("path", T.file_type(F.col("path")).alias("t"), T.language(T.file_type(F.col("path"))).alias("l")).collect()
    assert {r["path"]: r["t"] for r in rows} == names
    assert {r["path"]: r["l"] for r in rows}["b/c.PY"] == "python"


def test_globs_equal_fnmatch(spark):
    rng = random.Random(3)
    globs = ["*.log", "fixtures/*", "a?c", "[!a-c]x", "[]]", "[a", "*", "", "**/x", "[z-a]", "[!z-a]",
             "a[b-]c", "*a*b*c", "x.{y}", "[^a]", "a\\b", "?*?", "[[]x"]
    globs += ["".join(rng.choices("ab*?[]!-./", k=rng.randint(1, 6))) for _ in range(150)]
    names = ["", "a", "abc", "a/b/c.log", "x.log", "fixtures/x/y", "]", "[a", "ax", "dx", "a-c", "b", "^", "x.{y}", "a\nb"]
    names += ["".join(rng.choices("abc/.-[]!", k=rng.randint(1, 5))) for _ in range(60)]
    pairs = [(g, globs_to_regex([g]), n) for g in globs for n in names]
    df = spark.createDataFrame(pairs, "g string, r string, n string")
    got = df.select("g", "n", (F.regexp_instr("n", F.col("r")) > 0).alias("hit")).collect()
    # Java has no position for an empty match of an empty name; paths are never empty
    wrong = [(r["g"], r["n"]) for r in got if r["n"] and r["hit"] != fnmatch.fnmatchcase(r["n"], r["g"])]
    assert wrong == []


def test_ignore_file(make_files):
    files = make_files(
        ("a", ".reposecurityignore", "# comment\n\n*.log\n fixtures/*\r\n #kept\n"),
        ("a", "x.log", "x"), ("a", "fixtures/deep/x.py", "x"), ("a", "#kept", "x"), ("a", "y.py", "x"),
        ("b", "x.log", "x"), ("b", "sub/.reposecurityignore", "*"),
        ("c", ".reposecurityignore", "*", 1, True), ("c", "z.py", "x"),
    )
    globs = {r["repo_id"]: r["globs"] for r in paths.ignore_lists(files).collect()}
    assert globs == {"a": ["*.log", "fixtures/*", "#kept"]}
    kept = {(r["repo_id"], r["path"]) for r in paths.select_files(files).filter("selected").collect()}
    assert kept == {("a", ".reposecurityignore"), ("a", "y.py"), ("b", "x.log"),
                    ("b", "sub/.reposecurityignore"), ("c", "z.py")}


def test_cap_keeps_first_paths_of_each_repository(spark):
    files = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("repo_id"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"),
    )
    marked = paths.mark_beyond_cap(files, files, limit=1500)
    kept = {(r["repo_id"], r["path"]) for r in marked.filter("not beyond_cap").collect()}
    hot = sorted(f"f{i}" for i in range(3000) if i % 3)[:1500]
    assert kept == {("hot", p) for p in hot} | {("small", f"f{i}") for i in range(0, 3000, 3)}


def test_manifests_are_checked_even_when_filtered(make_files):
    files = make_files(
        ("r", ".reposecurityignore", "*"), ("r", "requirements.txt", b"# caf\xe9\nrequests==2.0.0\n"),
        ("s", "requirements.txt", b"requests==2.0.0\n", 16, True),
        ("t", "sub/requirements.txt", "requests==2.0.0\n"),
    )
    rows = {(r["repo_id"], r["path"]): r for r in scan(files).collect()}
    assert set(rows) == {("r", "dependencies"), ("t", "sub/requirements.txt")}
    assert rows["r", "dependencies"]["risk_score"] == 15.0


def test_an_ignore_list_without_link_flag_counts(make_files):
    files = make_files(("r", ".reposecurityignore", "*.log\n", 6, None), ("r", "x.log", "a", 1, None), ("r", "y.py", "a", 1, None))
    chosen = {r["path"] for r in select_files(files).filter("selected").collect()}
    assert "x.log" not in chosen and "y.py" in chosen


def test_ignore_lists_are_read_from_their_own_partition(spark, make_files, tmp_path):
    files = make_files(("r", ".reposecurityignore", "*.md"), ("r", "a.md", "eval(x)"), ("r", "a.py", "eval(x)"),
                       ("s", "a.md", "x"), ("s", None, "x"), ("s", "d/.reposecurityignore", "*"))
    stored = store_files(files, str(tmp_path / "files"))
    assert {r["path"] for r in stored.filter("control").collect()} == {".reposecurityignore"}
    assert sorted(map(repr, ignore_lists(stored).collect())) == sorted(map(repr, ignore_lists(files).collect()))
    plan = ignore_lists(stored)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(control#" in plan or "PartitionFilters: [control#" in plan
    seen = {(r["repo_id"], r["path"]): r["selected"] for r in select_files(stored).collect()}
    assert seen == {(r["repo_id"], r["path"]): r["selected"] for r in select_files(files).collect()}
    assert seen["r", "a.py"] and not seen["r", "a.md"] and seen["s", "a.md"]


def test_entropies_of_many_values_at_once(monkeypatch):
    monkeypatch.setattr(E, "BYTES_AT_ONCE", 40)
    monkeypatch.setattr(E, "VALUES_AT_ONCE", 5)
    values = [b"", b"aab", None, bytes(range(30)), b"x" * 100, b"", None, b"abcabcd" * 9, *(bytes([i, i, 0]) for i in range(20))]
    for data in (pa.array(values, pa.binary()), pa.array([b"zz", *values, b"q"], pa.binary()).slice(1, len(values))):
        got = E.byte_entropies(data).to_pylist()
        assert got == [None if v is None else pytest.approx(byte_entropy(v), abs=1e-12) for v in values]
    assert E.byte_entropies(pa.array([], pa.binary())).to_pylist() == []
    assert E.byte_entropies(pa.nulls(3, pa.binary())).to_pylist() == [None] * 3


def test_versions_and_texts_that_are_no_version(spark):
    good = {"1": [1], "1.2.0": [1, 2, 0], " 1 . 02": [1, 2], "-1.+2": [-1, 2], "1.\t2 ": [1, 2]}
    bad = ["", " ", ".", "1.", ".1", "1..2", ">=1.2", "1.x", "1.2\n.", "*", "1 2", "99999999999999999999", "1.2-3", "1.٣", None]
    rows = spark.createDataFrame([(v,) for v in [*good, *bad]], "v string").select("v", parse_version(F.col("v")).alias("got"))
    assert {r["v"]: r["got"] for r in rows.collect()} == {**good, **dict.fromkeys(bad)}
