"""File corpora derived from the star-schema test tables.

Each corpus has a Spark form and the same expression as ANSI SQL, so that a query can
be checked against an independent engine. Credential-shaped samples are put together
from pieces here; no complete one is stored.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.archives import shared_system
from riskloom.sources.tables import files_from_text, read_table, spread_small
from riskloom.storage import shared_folder

EXTENSIONS = [".py", ".js", ".sh", ".php", ".md"]

_RUN = "QWxhZGRpbjpvcGVuIHNlc2FtZQ" + "b3JlbSBpcHN1bSBkb2xvciBzaXQg" + "YW1ldA"
RUNS = [_RUN[i:] + _RUN[:i] for i in range(0, 56, 7)]

SNIPPETS = [
    "clean = 1",
    "# xmrig and stratum pool\nminerd --url",
    "CryptoNight cpuminer cgminer ethminer mining",
    "import socket\nsocket.bind(a)\nsocket.connect(b)",
    "os.system('id')",
    "x = eval(y)\nexec(z)",
    "mod = __import__('base64')",
    "subprocess.call(cmd)\nsubprocess.Popen(cmd)",
    "requests.get(u); requests.post(u, data=d)",
    "urllib.urlopen(u, data=x)\nurllib.request",
    "smtplib\nemail.send(m)",
    "telegram: my bot\ndiscord web, slack\nslack -> webhook",
    "telegram" + "x" * 300 + "bot",
    "discord" + "-" * 100 + "webhook",
    "zlib.compress(a)\nzlib.decompress(b)",
    "exec(payload.decode())",
    "popen\nos.popen(c)",
    "base64.b64decode(p)\nbase64.b64encode(q)\n" + "\n".join(RUNS[:6]),
    "BASE64.B64DECODE(p)",
    "\n".join(RUNS[:3]),
    "a = '" + "', '".join(RUNS[:7]) + "'",
    "commit " + "a1b2c3d4" * 10,
    "ftp.connect(h)\nnew WebSocket(u)",
    "setTimeout(f)\nsetInterval(g)\ndocument.write(h)\nel.innerHTML = 'a'\nnew Function(s)",
    "source ./env.sh\nexport A=1\nalias l=ls",
    "passthru(a)\nshell_exec(b)\nassert(c)\nsystem(d)",
    "medieval compile",
    "key = " + "AKIA" + "QRSTUVWX01234567",
    "key = " + "AKIA" + "EXAMPLE012345678 and EXAMPLE",
    "aws_secret_access_key = '" + "abcdefghij" * 4 + "'",
    "t1 = " + "ghp_" + "a1B2c3D4e5" * 4 + "\nt2 = " + "gho_" + "Z9y8X7w6V5" * 4,
    "lab: " + "glpat-" + "abcdefghij0123456789",
    "slack " + "xoxb-" + "123456789012-abcdef",
    "hook " + "https://hooks.slack.com" + "/services/" + "T00000000/B00000000/abcdefgh",
    "maps " + "AIza" + "S" * 35,
    "pay " + "sk_live_" + "a1b2c3d4" * 4 + " and " + "pk_test_" + "z9y8x7w6" * 4,
    "-----BEGIN RSA " + "PRIVATE KEY-----\nabc",
    "jwt " + "eyJ" + "hbGciOiJIUzI1" + ".eyJzdWIiOiIxMjM0" + ".SflKxwRJSMeKKF2QT4",
    "api_key = '" + "A1b2C3d4E5f6G7h8I9j0K1" + "'",
    "secret:\n\n  \"" + "m4n5b6v7c8x9z0a1s2d3f4" + "\"\ntoken = '" + "m4n5b6v7c8x9z0a1s2d3f4" + "'",
    "password = 'hunter2hunter2'; password = 'changeme123'\n  password: \"" + "p4ssw0rd!" + "\"",
    "token = '" + "ghp_" + "q" * 36 + "'",
    "sid " + "SK" + "0123456789abcdef" * 2,
    "mail " + "SG." + "a" * 22 + "." + "b" * 43,
    "password = 'your_password_here'\napi_key = 'test_key_0123456789abcdef'",
    "w" * 510 + "\nshort\n" + "v" * 1010,
]


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


def pick(values: list[str], index: Column) -> Column:
    """``values[index % n]``"""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def sql_pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[({index}) % {len(values)} + 1]"


# --- documents -----------------------------------------------------------------

def documents_with_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as source files of their ``source``; two thirds carry a snippet."""
    docs = spread_small(read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    doc_id = F.col("doc_id")
    text = F.when(doc_id % 3 == 0, F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit("\n"), pick(SNIPPETS, doc_id))
    )
    path = F.concat(F.col("lang"), F.lit("/doc_"), doc_id.cast("string"), pick(EXTENSIONS, doc_id))
    return files_from_text(docs, F.col("source"), path, text)


DOCUMENTS_SQL = f"""
docs AS (
  SELECT source AS repo_id, lang || '/doc_' || doc_id || {sql_pick(EXTENSIONS, 'doc_id')} AS path,
         {sql_pick(EXTENSIONS, 'doc_id')} AS ext,
         CASE WHEN doc_id % 3 = 0 THEN text
              ELSE text || chr(10) || {sql_pick(SNIPPETS, 'doc_id')} END AS text
  FROM documents
)"""


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw web pages, one repository per host."""
    pages = spread_small(read_table(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return files_from_text(pages, F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), path, F.col("html"))


PAGES_SQL = """
docs AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS repo_id,
         'pages/' || page_id || '.html' AS path, '.html' AS ext, html AS text
  FROM pages
)"""


ARCHIVES = 32


def archives_from_documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder of tars with all documents, 32 of each source, and of each source a copy
    of the last one that breaks off in its first header. Rows are streamed into one open
    archive a task; a new attempt of a task writes anew."""
    folder = f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"),
        F.concat_ws("-", "source", (F.col("doc_id") % ARCHIVES).cast("string")).alias("repo_id"),
    )

    def close(tar: tarfile.TarFile, stream, path: str, repo_id: str) -> None:
        tar.close()
        stream.close()
        system, inside = shared_system(folder)
        if repo_id.endswith(f"-{ARCHIVES - 1}"):
            with system.open_input_file(path) as whole, system.open_output_stream(f"{inside}/cut-{repo_id}.tar") as cut:
                cut.write(whole.read(400))
        system.move(path, f"{inside}/{repo_id}.tar")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inside = shared_system(folder)
        system.create_dir(inside, recursive=True)
        now = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if now is None or now[3] != row.repo_id:
                    if now:
                        close(*now)
                    path = f"{inside}/_{row.repo_id}.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(path)
                    now = tarfile.open(fileobj=stream, mode="w|"), stream, path, row.repo_id
                member = tarfile.TarInfo(f"./texts/{row.doc_id}.txt")
                member.size = len(row.text)
                now[0].addfile(member, io.BytesIO(row.text))
            yield pd.DataFrame({"n": [len(batch)]})
        if now:
            close(*now)

    docs.repartition("repo_id").sortWithinPartitions("repo_id").mapInPandas(pack, "n long").agg(F.sum("n")).first()
    return folder


ARCHIVES_SQL = f"""
packed AS (
  SELECT source || '-' || (doc_id % {ARCHIVES}) AS repo_id, doc_id, coalesce(text, '') AS text,
    doc_id % {ARCHIVES} = {ARCHIVES - 1} AS last
  FROM documents
)"""


# --- paths ---------------------------------------------------------------------

DIRS = ["src", "src/lib", "node_modules/a", "a/.git", "dist", "app/build/x", "docs",
        "tests/fixtures", "venv/lib", "pkg", "web"]
NAMES = ["main.py", "yarn.lock", "lib.min.js", "app.js", "logo.PNG", "debug.log", "notes.md",
         "go.sum", "style.min.css", "data.csv", "Archive.Zip", "x.go", "page1.txt", ".env"]
PATH_KEYS = ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]
PATH_SIZE_STEP = 7919

IGNORE_TEXTS = [
    "# comment\n\n*.log\n  docs/*  \n",
    "page[0-9].txt\nsrc/lib/?*_1/*\n #kept as a glob\n",
    "*/fixtures/*\nx.[!p]o\n",
    "\n#nothing\n",
    "pkg/*\n.env\n",
]
# the same globs as regexes, for the SQL form
IGNORE_REGEXES = [
    [r"^.*\.log$", r"^docs/.*$"],
    [r"^page[0-9]\.txt$", r"^src/lib/..*_1/.*$", r"^#kept as a glob$"],
    [r"^.*/fixtures/.*$", r"^x\.[^p]o$"],
    [],
    [r"^pkg/.*$", r"^\.env$"],
]


def paths_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path per line item over five repositories, each with an ignore file."""
    items = spread_small(read_table(spark, f"{sf_dir}/lineitem.parquet").select(*PATH_KEYS, "l_quantity"))
    folder = F.concat_ws("_", *[F.col(c).cast("string") for c in PATH_KEYS])
    path = F.concat_ws(
        "/", pick(DIRS, F.col("l_partkey")), folder, pick(NAMES, F.col("l_suppkey") + F.col("l_orderkey")),
    )
    paths = items.select(
        F.concat(F.lit("repo_"), (F.col("l_orderkey") % 5).cast("string")).alias("repo_id"),
        path.alias("path"),
        (F.col("l_partkey") * PATH_SIZE_STEP).cast("bigint").alias("size"),
        (F.col("l_quantity") == 13).alias("is_symlink"),
        F.lit(None).cast("binary").alias("content"),
    )
    nations = read_table(spark, f"{sf_dir}/nation.parquet")
    text = pick(IGNORE_TEXTS, F.col("n_nationkey"))
    ignore_files = files_from_text(
        nations, F.concat(F.lit("repo_"), F.col("n_nationkey").cast("string")),
        F.lit(".reposecurityignore"), text,
    )
    return paths.unionByName(ignore_files)


PATHS_SQL = f"""
paths AS (
  SELECT 'repo_' || (l_orderkey % 5) AS repo_id,
         {sql_pick(DIRS, 'l_partkey')} || '/' || {" || '_' || ".join(PATH_KEYS)} || '/' ||
         {sql_pick(NAMES, 'l_suppkey + l_orderkey')} AS path,
         l_partkey * {PATH_SIZE_STEP} AS size, l_quantity = 13 AS is_symlink
  FROM lineitem
  UNION ALL
  SELECT 'repo_' || n_nationkey, '.reposecurityignore',
         strlen({sql_pick(IGNORE_TEXTS, 'n_nationkey')}), false
  FROM nation
),
globs AS (
  SELECT DISTINCT 'repo_' || n_nationkey AS repo_id, unnest(g.regexes) AS regex
  FROM nation, (VALUES {", ".join(f"({i}, {sql_list(r) if r else '[]::VARCHAR[]'})" for i, r in enumerate(IGNORE_REGEXES))}) g(id, regexes)
  WHERE g.id = n_nationkey % {len(IGNORE_TEXTS)}
)"""


# --- container build files -----------------------------------------------------

# per line: alternatives, chosen by the order key divided by the divisor
DOCKER_LINES = [
    (1, ["FROM python:3.12-slim AS builder", "from ubuntu", "FROM node:latest as Web",
         "FROM scratch", "FROM registry.local:5000/app AS base"]),
    (5, ["RUN pip install .", "RUN curl -fsSL https://get.example.com | sudo bash",
         "RUN wget --no-check-certificate https://example.com/a", "RUN curl -k https://example.com",
         "RUN curl https://example.com/x.sh > x.sh", "RUN curl --insecure https://e.com|sh"]),
    (7, ["FROM builder", "FROM WEB", "FROM base", "# no second stage", "FROM alpine:3.19",
         "FROM --platform=linux/amd64 alpine"]),
    (11, ["ADD app.py /app/", "ADD https://example.com/f.bin /app/", "ADD --chown=a:b src /src",
          "ADD pkg.tar.gz /opt/", "COPY . .", "ADD --a --b"]),
    (13, ["ENV DB_PASSWORD=supersecret123", "ENV DB_PASSWORD=x", "ARG API_KEY longvalue1",
          "ENV FOO=bar MY_TOKEN_X = abcdefgh99", "ENV A=1", "LABEL secret=abcdefghijk"]),
    (17, ["USER app", "USER root", "USER 0:0", "USER 1000", "# nobody", "user rootless", "USER 0"]),
    (19, ["CMD [\"python\"]", "USER root:root", "RUN wget -q http://x.y/z | /bin/bash", ""]),
]


def dockerfiles_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One container build file per order, lines chosen by the order key."""
    orders = spread_small(read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    key = F.col("o_orderkey")
    lines = [pick(options, F.floor(key / divisor)) for divisor, options in DOCKER_LINES]
    names = ["Dockerfile", "Dockerfile.prod", "app.dockerfile", "Dockerfiles"]
    path = F.concat(F.lit("svc/"), key.cast("string"), F.lit("/"), pick(names, key))
    repo = F.concat(F.lit("team_"), (F.col("o_custkey") % 50).cast("string"))
    return files_from_text(orders, repo, path, F.concat_ws("\n", *lines))


DOCKER_SQL = f"""
docker AS (
  SELECT 'team_' || (o_custkey % 50) AS repo_id,
         'svc/' || o_orderkey || '/' || {sql_pick(["Dockerfile", "Dockerfile.prod", "app.dockerfile", "Dockerfiles"], 'o_orderkey')} AS path,
         {" || chr(10) || ".join(sql_pick(options, f'o_orderkey // {divisor}') for divisor, options in DOCKER_LINES)} AS text
  FROM orders
)"""


# --- manifests and advisories --------------------------------------------------

PIP_PACKAGES = ["requests", "urllib3", "Paramiko", "cryptography", "PyYAML", "flask",
                "numpy", "Requests", "attrs", "urllib3-extra", "my_pkg", "pip"]
NPM_PACKAGES = ["crypto-js", "node-fetch", "axios", "lodash", "request", "react",
                "vue", "express", "left-pad", "chalk", "debug", "axios-mock"]
PIP_FORMS = ["{p}=={v}", "{p}", "  {p}=={v}", "{p}>={v}", "# {p}=={v}", "{p}=={v}.", "{p}=={v} ; x"]
NPM_PREFIXES = ["^", "~", "", "=", ">=", "^~"]


MANIFEST_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_VERSION_SQL = "(l_suppkey % 6) || '.' || CAST(l_quantity AS INT) || '.' || (l_partkey % 4)"


def _version(item: Column) -> Column:
    return F.concat_ws(
        ".", (item["l_suppkey"] % 6).cast("string"), item["l_quantity"].cast("int").cast("string"),
        (item["l_partkey"] % 4).cast("string"),
    )


def _pip_line(order: Column, item: Column, i: Column) -> Column:
    package = pick(PIP_PACKAGES, order + i)
    form = pick(PIP_FORMS, item["l_partkey"])
    return F.replace(F.replace(form, F.lit("{p}"), package), F.lit("{v}"), _version(item))


def _npm_package(order: Column, i: Column) -> Column:
    """Names are unique within a manifest: a suffix from the 13th entry on."""
    name = pick(NPM_PACKAGES, order + i)
    again = F.concat(name, F.lit("-"), i.cast("string"))
    return F.when(i < len(NPM_PACKAGES), name).otherwise(again)


def manifests_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per order, one entry per line item; a repository per order."""
    items = read_table(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", *MANIFEST_KEYS)
    # an order holds a handful of line items
    orders = items.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(*MANIFEST_KEYS))).alias("items")
    )
    order = F.col("l_orderkey")
    pip_text = F.array_join(F.transform("items", lambda x, i: _pip_line(order, x, i)), "\n")
    npm_lines = F.transform("items", lambda x, i: F.concat(
        F.lit('    "'), _npm_package(order, i), F.lit('": "'),
        pick(NPM_PREFIXES, x["l_partkey"]), _version(x), F.lit('"'),
    ))
    npm_text = F.concat(
        F.lit('{\n  "name": "x",\n  "dependencies": {\n'), F.array_join(npm_lines, ",\n"),
        F.lit("\n  }\n}\n"),
    )
    is_pip = order % 2 == 0
    return files_from_text(
        orders, F.concat(F.lit("order_"), order.cast("string")),
        F.when(is_pip, "requirements.txt").otherwise("package.json"),
        F.when(is_pip, pip_text).otherwise(npm_text),
    )


MANIFESTS_SQL = f"""
items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(MANIFEST_KEYS)}) - 1 AS i
  FROM lineitem
),
pip_lines AS (
  SELECT 'order_' || l_orderkey AS repo_id, 'requirements.txt' AS path, i + 1 AS line,
         replace(replace({sql_pick(PIP_FORMS, 'l_partkey')}, '{{p}}', {sql_pick(PIP_PACKAGES, 'l_orderkey + i')}),
                 '{{v}}', {_VERSION_SQL}) AS entry
  FROM items WHERE l_orderkey % 2 = 0
),
npm_lines AS (
  SELECT 'order_' || l_orderkey AS repo_id, 'package.json' AS path, i + 1 AS pos,
         {sql_pick(NPM_PACKAGES, 'l_orderkey + i')} ||
           CASE WHEN i < {len(NPM_PACKAGES)} THEN '' ELSE '-' || i END AS package,
         {sql_pick(NPM_PREFIXES, 'l_partkey')} || {_VERSION_SQL} AS spec
  FROM items WHERE l_orderkey % 2 = 1
),
pip_deps AS (
  SELECT repo_id, path, 'PyPI' AS ecosystem,
         lower(regexp_extract(trim(entry), '^([a-zA-Z0-9_-]+)(==([0-9.]+))?', 1)) AS package,
         nullif(regexp_extract(trim(entry), '^([a-zA-Z0-9_-]+)(==([0-9.]+))?', 3), '') AS pinned,
         line, row_number() OVER (PARTITION BY repo_id ORDER BY line) - 1 AS ord
  FROM pip_lines WHERE regexp_matches(trim(entry), '^[a-zA-Z0-9_-]')
),
npm_deps AS (
  SELECT repo_id, path, 'npm' AS ecosystem, package, ltrim(spec, '^~=') AS pinned,
         pos + 3 AS line, pos - 1 AS ord
  FROM npm_lines
),
deps AS (
  SELECT *, CASE WHEN regexp_full_match(pinned, '[0-9]+(\\.[0-9]+)*')
                 THEN CAST(string_split(pinned, '.') AS BIGINT[]) END AS version
  FROM (SELECT * FROM pip_deps UNION ALL SELECT * FROM npm_deps)
)"""


def advisories_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories over the manifests' packages; ranges come from size and key."""
    part = read_table(spark, f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    npm = key % 2 == 1
    package = F.when(npm, pick(NPM_PACKAGES, F.floor(key / 2))).otherwise(
        F.lower(pick(PIP_PACKAGES, F.floor(key / 2)))
    )

    def version(last):
        return F.array(key % 6, (F.col("p_size") % 50).cast("bigint"), F.lit(last).cast("bigint"))

    return part.select(
        F.when(npm, "npm").otherwise("PyPI").alias("ecosystem"), package.alias("package"),
        F.when(key % 100 != 0, version(1)).alias("introduced"),
        F.when(key % 100 == 0, F.array(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))
        .otherwise(version(4)).alias("fixed"),
        F.concat(F.lit("ADV-"), key.cast("string")).alias("id"),
        F.when(key % 3 == 0, "").otherwise(F.col("p_name")).alias("summary"),
        F.when(key % 6 == 0, "").otherwise(F.repeat(F.concat("p_type", F.lit(" ")), F.lit(9))).alias("details"),
    )


ADVISORIES_SQL = f"""
advisories AS (
  SELECT CASE WHEN p_partkey % 2 = 1 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
         CASE WHEN p_partkey % 2 = 1 THEN {sql_pick(NPM_PACKAGES, 'p_partkey // 2')}
              ELSE lower({sql_pick(PIP_PACKAGES, 'p_partkey // 2')}) END AS package,
         CASE WHEN p_partkey % 100 <> 0 THEN [p_partkey % 6, p_size % 50, 1]::BIGINT[] END AS introduced,
         CASE WHEN p_partkey % 100 = 0 THEN [0, 2]::BIGINT[]
              ELSE [p_partkey % 6, p_size % 50, 4]::BIGINT[] END AS fixed,
         'ADV-' || p_partkey AS id,
         CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS summary,
         CASE WHEN p_partkey % 6 = 0 THEN '' ELSE repeat(p_type || ' ', 9) END AS details
  FROM part
)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything above with contents: documents, build files and manifests."""
    return (
        documents_with_payloads(spark, sf_dir)
        .unionByName(dockerfiles_from_orders(spark, sf_dir))
        .unionByName(manifests_from_lineitem(spark, sf_dir))
    )
