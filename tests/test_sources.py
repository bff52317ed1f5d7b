"""Archives, trees, streams."""

import io
import os
import tarfile

from pyspark.sql import functions as F

from riskloom.plans.scan import analyze
from riskloom.plans.summary import rollup
from riskloom.plans.summary import rollup
from riskloom.sources.archives import read_archives
from riskloom.sources.trees import expand_archives, read_trees
from riskloom.streaming import arrivals


def test_archives(spark, tmp_path):
    def add(tar, name, data=b"", **extra):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        for key, value in extra.items():
            setattr(info, key, value)
        tar.addfile(info, io.BytesIO(data))

    for name, mode in (("one.tar", "w"), ("two.git.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            add(tar, "./.env", b"A=1")
            add(tar, "_u.py", b"eval(x)")
            add(tar, "d", type=tarfile.DIRTYPE)
            add(tar, "link", type=tarfile.SYMTYPE, linkname="/etc/passwd")
    rows = {(r["repo_id"], r["path"]): r for r in read_archives(spark, str(tmp_path)).collect()}
    assert {p for _, p in rows} == {".env", "_u.py", "link"} and len(rows) == 6
    assert {r for r, _ in rows} == {"one", "two.git"}
    assert bytes(rows["one", "_u.py"]["content"]) == b"eval(x)"
    assert rows["one", "link"]["is_symlink"] and rows["one", "link"]["content"] is None


def test_trees(spark, tmp_path):
    repo = tmp_path / "build" / "repo"
    (repo / "node_modules").mkdir(parents=True)
    (repo / "_h").mkdir()
    (repo / ".env").write_text("A=1")
    (repo / "_h" / "a.py").write_text("eval(x)")
    (repo / "node_modules" / "b.py").write_text("x")
    (tmp_path / "outside.txt").write_text("x")
    os.symlink(tmp_path / "outside.txt", repo / "link.txt")
    os.symlink(tmp_path, repo / "dirlink")
    rows = {r["path"]: r for r in read_trees(spark, [str(repo)]).collect()}
    assert set(rows) == {".env", "_h/a.py", "link.txt"}
    assert rows["link.txt"]["is_symlink"] and rows["link.txt"]["content"] is None
    assert rows["_h/a.py"]["size"] == 7 and rows["_h/a.py"]["repo_id"] == "repo"


def test_stream_equals_batch(spark, make_files, tmp_path):
    files = make_files(("r", "a.py", "eval(x)"), ("r", "b.sh", "export A=1"), ("s", "yarn.lock", "eval("), ("s", "c.txt", "xmrig"))
    for part in (0, 1):
        files.filter(F.pmod(F.hash("path"), F.lit(2)) == part).write.mode("append").parquet(str(tmp_path / "in"))
    results = arrivals.scan_arrivals(arrivals.read_arrivals(spark, str(tmp_path / "in")))
    arrivals.write_results(results, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ["repo_id", "path", "risk_score"]
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(columns).collect()}
    batch = {tuple(r) for r in analyze(files.filter("path <> 'yarn.lock'")).select(columns).collect()}
    assert streamed == batch and len(batch) == 3

    arrivals.write_rollups(results, str(tmp_path / "roll"), str(tmp_path / "cp2")).awaitTermination()
    totals = spark.read.parquet(str(tmp_path / "roll")).groupBy("repo_id").agg(F.sum("total_files").alias("n"))
    assert {tuple(r) for r in totals.collect()} == {
        tuple(r) for r in rollup(analyze(files.filter("path <> 'yarn.lock'"))).select("repo_id", "total_files").collect()}


def test_a_broken_archive_is_one_row_with_its_error(spark, tmp_path):
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w") as tar:
        for name in ("a", "b"):
            info = tarfile.TarInfo(name)
            info.size = 3000
            tar.addfile(info, io.BytesIO(b"x" * 3000))
    (tmp_path / "cut.tar").write_bytes(whole.getvalue()[:5000])
    (tmp_path / "none.tar").write_bytes(b"no archive" * 100)
    (tmp_path / "fine.tar").write_bytes(whole.getvalue())
    rows = [(r["repo_id"], r["path"], r["read_error"] is None) for r in read_archives(spark, str(tmp_path)).collect()]
    assert sorted(rows) == [
        ("cut", "(archive)", False), ("cut", "a", True), ("fine", "a", True), ("fine", "b", True), ("none", "(archive)", False)]


def big_archive(path, sizes, small=200):
    """A sparse archive: members of the given sizes, each followed by small ones."""
    with open(path, "wb") as out:
        for i, size in enumerate(sizes):
            info = tarfile.TarInfo(f"big{i}.bin")
            info.size = size
            out.write(info.tobuf())
            out.seek(out.tell() + -(-size // 512) * 512)
            for k in range(small):
                data = b"%d-%d" % (i, k)
                info = tarfile.TarInfo(f"dir{i}/{k}.txt")
                info.size = len(data)
                out.write(info.tobuf() + data.ljust(512, b"\0"))
        out.truncate(out.tell() + 1024)


def test_an_archive_over_two_gigabytes_is_read_in_ranges(spark, tmp_path):
    big_archive(tmp_path / "huge.tar", [1_500_000_000, 900, 1_200_000_000, 20_000_000])
    assert (tmp_path / "huge.tar").stat().st_size > 2**31
    files = read_archives(spark, str(tmp_path / "huge.tar"), range_bytes=50_000)
    got = files.select(
        "path", "size", F.octet_length("content").alias("n"), F.when(F.col("size") < 900, F.col("content")).alias("c"), "read_error"
    ).collect()
    rows = {r["path"]: r for r in got}
    assert len(got) == len(rows) == 804 and {r["size"] for r in got} >= {1_500_000_000, 1_200_000_000, 20_000_000}
    assert [rows[f"big{i}.bin"]["read_error"] is None for i in range(4)] == [False, True, False, True]
    assert rows["big3.bin"]["n"] == 20_000_000 and rows["big0.bin"]["n"] is None
    assert all(bytes(rows[f"dir{i}/{k}.txt"]["c"]) == b"%d-%d" % (i, k) for i in range(4) for k in range(200))


def test_archives_that_break_in_a_later_range(spark, tmp_path):
    big_archive(tmp_path / "whole.tar", [5000, 5000], small=100)
    data = (tmp_path / "whole.tar").read_bytes()
    (tmp_path / "data.tar").write_bytes(data[: 512 + 5120 + 100 * 1024 + 512 + 700])
    (tmp_path / "header.tar").write_bytes(data[: 512 + 5120 + 50 * 1024 + 100])
    junk = 512 + 5120 + 30 * 1024
    (tmp_path / "junk.tar").write_bytes(data[:junk] + b"#" * 4096 + data[junk + 4096 :])
    (tmp_path / "empty.tar").write_bytes(bytes(10240))
    (tmp_path / "nothing.tar").write_bytes(b"")
    for size in (4000, 1 << 30):
        rows = read_archives(spark, str(tmp_path), range_bytes=size).groupBy("repo_id").agg(
            F.count_if(F.col("read_error").isNull()).alias("good"), F.count_if(F.col("read_error").isNotNull()).alias("bad"),
        ).collect()
        assert {r["repo_id"]: (r["good"], r["bad"]) for r in rows} == {
            "whole": (202, 0), "data": (101, 1), "header": (51, 1), "junk": (31, 1)}


def test_hard_links_reach_into_other_ranges(spark, tmp_path):
    for name, mode in (("plain.tar", "w"), ("packed.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for i in range(50):
                info = tarfile.TarInfo(f"f{i}")
                info.size = 2000
                tar.addfile(info, io.BytesIO(b"%4d" % i * 500))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.LNKTYPE, "f3"
            tar.addfile(link)
            long = tarfile.TarInfo("n" * 300)
            long.size = 3
            tar.addfile(long, io.BytesIO(b"end"))
            lost = tarfile.TarInfo("lost")
            lost.type, lost.linkname = tarfile.LNKTYPE, "nowhere"
            tar.addfile(lost)
    rows = {(r["repo_id"], r["path"]): r for r in read_archives(spark, str(tmp_path), range_bytes=5000).collect()}
    assert len(rows) == 106
    for repo in ("plain", "packed"):
        assert bytes(rows[repo, "link"]["content"]) == b"   3" * 500 and rows[repo, "link"]["size"] == 2000
        assert bytes(rows[repo, "n" * 300]["content"]) == b"end" and rows[repo, "lost"]["read_error"]


def test_archives_in_cells(spark):
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w") as tar:
        info = tarfile.TarInfo("./a")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    table = spark.createDataFrame([("x", whole.getvalue()), ("y", b"none"), ("z", None)], "repo_id string, content binary")
    rows = sorted((r["repo_id"], r["path"], r["read_error"] is None) for r in expand_archives(table).collect())
    assert rows == [("x", "a", True), ("y", "(archive)", False), ("z", "(archive)", False)]


def test_a_file_that_arrives_again_replaces_its_result(spark, make_files, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        files = make_files(*(r[:3] for r in rows)).withColumn("version", F.lit(rows[0][3]).cast("bigint"))
        files.write.mode("append").parquet(source)
        results = arrivals.scan_arrivals(arrivals.read_arrivals(spark, source, arrivals.VERSIONED_SCHEMA))
        changes = arrivals.result_changes(results)
        arrivals.write_results(changes, out, str(tmp_path / "cp")).awaitTermination()
        now = arrivals.rollup_changes(spark.read.schema(arrivals.CHANGES_SCHEMA).parquet(out))
        return {r["repo_id"]: (r["total_files"], r["overall_risk_score"], r["findings_count"], r["cautions_count"]) for r in now.collect()}

    two = "eval(x)\nexec(y)\nrequests.get(u)"
    whole = analyze(make_files(("r", "a.py", two), ("r", "b.py", "eval(x)"))).collect()
    score, n = {r["path"]: r["risk_score"] for r in whole}, {r["path"]: len(r["findings"]) for r in whole}
    both = arrive(("r", "a.py", two, 5), ("r", "b.py", "eval(x)", 5), ("s", "c.py", "", 5))
    assert both["r"][:2] == (2, max(score.values())) and both["s"] == (1, 0.0, 0, 0)
    assert arrive(("r", "a.py", "clean", 4), ("s", "c.py", two, 4)) == both  # older ones
    assert arrive(("r", "a.py", two, 5)) == both  # the same again
    assert arrive(("r", "a.py", "clean", 6))["r"] == (2, score["b.py"], n["b.py"], 0)
    assert arrive(("r", None, two, 9), (None, "a.py", two, 9))["r"] == (2, score["b.py"], n["b.py"], 0)


def test_rows_that_a_stream_can_not_place_are_left_out(spark):
    none = spark.createDataFrame([], arrivals.CHANGES_SCHEMA)
    assert arrivals.rollup_changes(none).count() == 0


def test_files_share_the_state_of_a_group(spark, make_files, tmp_path):
    """Python is called once a group, not once a file, and files of a group stay apart."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    two = "eval(x)\nexec(y)\nrequests.get(u)"

    def arrive(version, *rows):
        make_files(*rows).withColumn("version", F.lit(version).cast("bigint")).write.mode("append").parquet(source)
        results = arrivals.scan_arrivals(arrivals.read_arrivals(spark, source, arrivals.VERSIONED_SCHEMA))
        query = arrivals.write_results(arrivals.result_changes(results, groups=2), out, str(tmp_path / "cp"))
        query.awaitTermination()
        states = sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"])
        now = arrivals.rollup_changes(spark.read.schema(arrivals.CHANGES_SCHEMA).parquet(out))
        return states, {r["repo_id"]: (r["total_files"], r["findings_count"]) for r in now.collect()}

    n = rollup(analyze(make_files(("r", "a.py", two)))).first()["findings_count"]
    first = [(f"r{i % 3}", f"f{i // 3}.py", two if i % 2 else "") for i in range(60)]
    states, held = arrive(2, *first)
    assert states <= 2 and held == {f"r{i}": (20, 10 * n) for i in range(3)}
    # newer forms of some, older ones of others, and the same path in another repository
    _, held = arrive(3, ("r0", "f0.py", two), ("r1", "f0.py", ""), ("r9", "f0.py", two))
    assert held == {"r0": (20, 11 * n), "r1": (20, 9 * n), "r2": (20, 10 * n), "r9": (1, n)}
    assert arrive(1, *first)[1] == held
