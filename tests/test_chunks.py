"""Huge files in chunks: same results as whole ones, wherever they are cut."""

import io
import random
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from riskloom.functions.entropy import byte_entropy
from riskloom.plans.chunks import file_entropy, merge_chunks, scan_chunks, scan_each_chunk
from riskloom.plans.scan import analyze
from riskloom.sources.archives import read_archives
from riskloom.sources.chunks import cut_files, next_cut, read_large_members
from riskloom.sources.corpora import RUNS, SNIPPETS

COLUMNS = ["repo_id", "path", "size", "file_type", "is_binary", "findings", "risk_score"]
LINES = [s for s in SNIPPETS if len(s) < 300] + [
    "", "  ", "\t", "x = 1", "password", "  = ", "token :", "'" + "abcdefghij" * 3 + "'", ": 'p4ssw0rdp4ss'", '"q1w2e3r4t5"',
    "aws_secret_access_key =", "abcdefghij" * 4, "é = à", " ", "api_key", "\r", "y" * 600, *RUNS[:3],
]


def rows(df):
    return sorted((tuple(r[c] if c != "findings" else tuple(map(tuple, r[c])) for c in COLUMNS), round(r["entropy"] or 0, 9))
                  for r in df.collect())


@pytest.fixture(scope="module")
def files(make_files):
    rng = random.Random(7)
    out = []
    for i in range(60):
        end = rng.choice(["\n", "\n", "\r\n", "\r"])
        text = end.join(rng.choice(LINES) for _ in range(rng.randint(0, 60)))
        out.append((f"r{i % 3}", f"f{i}" + rng.choice([".py", ".js", ".sh", ".php", ""]), text))
    docker = "FROM a:1 AS b\n" + "RUN x\n" * 40 + "FROM b\nENV A_TOKEN=abcdefgh99\n"
    out += [
        ("r", "Dockerfile", docker), ("r", "x/app.dockerfile", docker), ("r", "empty.py", b""), ("r", "gone.py", None),
        ("r", "utf16.py", "\n".join(SNIPPETS[:20]).encode("utf-16")), ("r", "nul.py", b"eval(x)\n\x00\n" + b"exec(y)\n" * 40),
        ("r", "late.py", b"eval(x)\n" * 200 + b"\x00\xff\nexec(y)\n" * 40), ("r", "mark.py", b"a = 1\n" * 60 + b"\xff\xfeexec(y)\n" * 9),
        ("r", "noise.bin", bytes(rng.randrange(256) for _ in range(6000))), ("r", "a/yarn.lock", "eval(x)"),
        ("r", "big.py", "eval(x)", 60 << 20, False), ("r", "link.py", "eval(x)", 7, True), ("r", "nosize.py", "eval(x)", None, False),
    ]
    return make_files(*out).cache()


@pytest.mark.parametrize("chunk_bytes", [1, 333])
def test_chunks_give_the_results_of_whole_files(files, chunk_bytes):
    chunks = cut_files(files, chunk_bytes)
    if chunk_bytes < 100:
        assert chunks.count() > 3 * files.count()
    whole = analyze(files.filter("path not in ('a/yarn.lock', 'link.py')"))
    assert rows(scan_chunks(chunks)) == rows(whole)


def test_chunks_make_up_the_file(files):
    parts = cut_files(files, 50).groupBy("repo_id", "path").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "content"))).alias("parts"), F.max("content").isNull().alias("none")
    ).join(files.select("repo_id", "path", F.col("content").alias("whole")), ["repo_id", "path"])
    for r in parts.collect():
        assert r["whole"] is None if r["none"] else b"".join(p["content"] for p in r["parts"]) == r["whole"]


def test_cuts_do_not_depend_on_the_block_and_hostile_blanks_are_linear():
    rng = random.Random(3)
    for _ in range(300):
        data = "".join(rng.choice(["a", "=", "\n", " ", "'", ":", "é"]) for _ in range(rng.randint(0, 60))).encode()
        read = lambda first, n, data=data: data[first:first + n]
        for offset in (0, 5, 20):
            cuts = {next_cut(read, len(data), offset, block) for block in (1, 2, 7, 1000)}
            assert len(cuts) == 1
            cut = cuts.pop()
            assert cut == len(data) or (data[cut - 1:cut] == b"\n" and cut > offset and data[cut:].strip()[:1] not in (b"'", b"=", b":"))
    blank = b"a" + b"\n" * 3_000_000 + b"'" + b"= \n" * 300_000
    start = time.perf_counter()
    assert next_cut(lambda first, n: blank[first:first + n], len(blank), 0) == len(blank)
    assert time.perf_counter() - start < 5


def test_large_members_of_archives_are_read_in_chunks(spark, tmp_path):
    text = "".join(f"x{i} = 'line'\n" for i in range(40_000)) + "eval(y)\npassword = 'hunter2hunter2'\n"
    with tarfile.open(tmp_path / "repo.tar", "w") as tar:
        for name, data in (("small.py", b"eval(x)"), ("big.py", text.encode()), ("also.py", text.encode() * 2)):
            info = tarfile.TarInfo(f"./src/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "none.tar").write_bytes(b"no archive" * 100)
    chunks = read_large_members(spark, str(tmp_path), over=1000, chunk_bytes=50_000)
    assert chunks.agg(F.max(F.octet_length("content"))).first()[0] < 50_100 and chunks.count() > 30
    whole = read_archives(spark, str(tmp_path)).filter("size > 1000")
    assert rows(scan_chunks(chunks)) == rows(analyze(whole))
    assert {r["path"] for r in scan_chunks(chunks).collect()} == {"src/big.py", "src/also.py"}


def test_only_the_counts_of_files_in_chunks_become_rows(spark, make_files):
    """Files of one chunk keep the entropy of their own counts; a path that came twice, and
    files in chunks, have that of all their bytes."""
    rng = random.Random(5)
    noise = bytes(rng.randrange(256) for _ in range(3000))
    files = make_files(
        ("r", "one.py", "a = 1\nb = 2\n"), ("r", "empty.py", b""), ("r", "gone.py", None), ("r", "same.py", "aaaa"),
        ("r", "noise.bin", noise), ("r", "twice.py", "a = 1\n"), ("r", "twice.py", "bb = 22\n"), ("r", "long.py", "x = 1\n" * 900),
    )
    scanned = scan_each_chunk(cut_files(files, 4096))
    assert {r["path"] for r in file_entropy(scanned).collect()} == {"twice.py", "long.py"}
    found = {r["path"]: r["entropy"] for r in merge_chunks(scanned).collect()}
    whole = {"one.py": b"a = 1\nb = 2\n", "empty.py": b"", "same.py": b"aaaa", "noise.bin": noise,
             "twice.py": b"a = 1\nbb = 22\n", "long.py": b"x = 1\n" * 900}
    assert found.pop("gone.py") is None
    assert found == pytest.approx({path: byte_entropy(data) for path, data in whole.items()}, abs=1e-9)
    widest = scanned.agg(F.max(F.size("byte_counts"))).first()[0]
    assert widest == 256 and scanned.where("path = 'same.py'").first()["byte_counts"] == [4 * 256 + ord("a")]
