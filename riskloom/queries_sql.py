"""The registered queries as ANSI SQL, for comparison with an independent engine.

The SQL is written from the rules, not from the Spark plans: patterns run as plain
regexes over whole texts, without the gates and linear forms of the operators.
"""

from __future__ import annotations

from riskloom import rules
from riskloom.queries import OWN_RULES, SMALL_CAP
from riskloom.sources import corpora
from riskloom.sources.corpora import sql_list, sql_text

NL = "chr(10)"


def lines_in(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {NL}, '')))"


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select


# --- detectors over docs(repo_id, path, ext, text) -------------------------------

def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _first_hits(name: str, entries: list[tuple[int, str, str, str]]) -> str:
    """CTE (repo_id, path, k1, label, pattern, line) of first matches."""
    parts = [
        f"""SELECT repo_id, path, {ord_} AS k1, {sql_text(label)} AS label, {sql_text(pattern)} AS pattern,
  1 + {lines_in(f"string_split_regex(low, {sql_text(pattern)})[1]")} AS line
FROM lows WHERE regexp_matches(low, {sql_text(pattern)})"""
        for ord_, label, pattern, _ in entries
    ]
    return f"{name} AS (\n{_union(parts)}\n)"


LOWS = "lows AS (SELECT repo_id, path, lower(text) AS low FROM docs)"

def _malicious(groups: dict[str, list[str]]) -> list[str]:
    entries = [(c, p) for c, ps in groups.items() for p in ps]
    return [
        LOWS,
        _first_hits("malicious_hits", [(i, c, p, "") for i, (c, p) in enumerate(entries)]),
        f"""malicious AS (
  SELECT repo_id, path, 1 AS det, k1, 0 AS k2,
    CASE WHEN count(*) OVER (PARTITION BY repo_id, path) * {rules.POINTS_PATTERN} > {rules.MEDIUM_ABOVE}
         THEN 'medium' ELSE 'low' END AS severity,
    label AS category, 'Malicious pattern: ' || pattern AS description, pattern, line,
    {rules.POINTS_PATTERN} AS points
  FROM malicious_hits
)""",
    ]


MALICIOUS = _malicious(rules.MALICIOUS_PATTERNS)

LONG_LINE = [
    """doc_lines AS (
  SELECT repo_id, path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS n
  FROM (SELECT repo_id, path, string_split(text, chr(10)) AS ls FROM docs)
)""",
    f"""long_line AS (
  SELECT repo_id, path, 2 AS det, n AS k1, 0 AS k2, 'info' AS severity, 'long_line' AS category,
    CASE WHEN length(l) > {rules.EXTREMELY_LONG_LINE} THEN 'extremely long line: ' ELSE 'long line: ' END
      || length(l) || ' chars' AS description,
    NULL AS pattern, n AS line, 0 AS points
  FROM doc_lines WHERE length(l) > {rules.LONG_LINE}
)""",
]


def _functions(table: dict[str, list[str]]) -> str:
    parts = []
    for lang, names in table.items():
        exts = ", ".join(sql_text(e) for e, l in rules.LANGUAGE_BY_EXTENSION.items() if l == lang)
        for i, fn in enumerate(names):
            parts.append(f"""SELECT repo_id, path, 3 AS det, {i} AS k1, 0 AS k2, 'low' AS severity,
  'dangerous_function' AS category, 'Dangerous function: ' || {sql_text(fn)} AS description, NULL AS pattern,
  1 + {lines_in(f"substr(text, 1, strpos(text, {sql_text(fn)}) - 1)")} AS line, {rules.POINTS_FUNCTION} AS points
FROM docs WHERE lower(ext) IN ({exts}) AND contains(text, {sql_text(fn)})""")
    return f"dangerous_fn AS (\n{_union(parts)}\n)"


DANGEROUS = [_functions(rules.DANGEROUS_FUNCTIONS)]

RUNS = f"""runs AS (
  SELECT repo_id, path, text, list_filter(
    regexp_extract_all(text, {sql_text(rules.BASE64_RUN)}),
    lambda x: length(x) % 4 = 0 AND list_entropy(string_split(x, '')) >= {rules.BASE64_MIN_ENTROPY}) AS rs
  FROM docs
)"""


def _encoding() -> list[str]:
    calls = [
        f"""SELECT repo_id, path, {i + 1} AS k1, {sql_text(description)} AS description,
  1 + {lines_in(f"substr(low, 1, strpos(low, {sql_text(literal)}) - 1)")} AS line, {points} AS points
FROM lows WHERE contains(low, {sql_text(literal)})"""
        for i, (literal, description, points) in enumerate(rules.BASE64_CALLS)
    ]
    counted = f"""SELECT repo_id, path, 0 AS k1,
  CASE WHEN len(rs) > {rules.BASE64_MANY} THEN 'Multiple base64 strings: ' ELSE 'Base64 strings: ' END || len(rs) AS description,
  1 + {lines_in("substr(text, 1, strpos(text, rs[1]) - 1)")} AS line,
  CASE WHEN len(rs) > {rules.BASE64_MANY} THEN {rules.POINTS_BASE64_MANY} ELSE {rules.POINTS_BASE64_FEW} END AS points
FROM runs WHERE len(rs) > {rules.BASE64_FEW}"""
    return [
        RUNS,
        f"encoding_hits AS (\n{_union([counted, *calls])}\n)",
        f"""encoding AS (
  SELECT repo_id, path, 4 AS det, k1, 0 AS k2,
    CASE WHEN sum(points) OVER (PARTITION BY repo_id, path) > {rules.MEDIUM_ABOVE} THEN 'medium' ELSE 'low' END AS severity,
    'encoding' AS category, description, NULL AS pattern, line, points
  FROM encoding_hits
)""",
    ]


ENCODING = _encoding()

def _network(entries: list[tuple[str, str]]) -> list[str]:
    return [
        _first_hits("network_hits", [(i, label, p, "") for i, (p, label) in enumerate(entries)]),
        """network AS (
  SELECT repo_id, path, 5 AS det, k1, 0 AS k2, 'info' AS severity, 'network' AS category,
    label AS description, NULL AS pattern, line, 0 AS points
  FROM network_hits
)""",
    ]


NETWORK = _network(rules.NETWORK_PATTERNS)


def _secrets(patterns: dict[str, str]) -> list[str]:
    parts = [
        f"""SELECT repo_id, path, {i} AS k1, {sql_text(name)} AS name,
  regexp_extract_all(text, {sql_text(p)}, 1) AS vals, regexp_extract_all(text, {sql_text(p)}, 0) AS ms,
  string_split_regex(text, {sql_text(p)}) AS ps
FROM docs WHERE regexp_matches(text, {sql_text(p)})"""
        for i, (name, p) in enumerate(patterns.items())
    ]
    before = "array_to_string(ps[1:i], '') || coalesce(array_to_string(ms[1:i - 1], ''), '')"
    marked = " OR ".join(f"contains(lower(v), {sql_text(m)})" for m in rules.SECRET_PLACEHOLDERS)
    return [
        f"secret_matches AS (\n{_union(parts)}\n)",
        "secret_items AS (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM secret_matches)",
        f"""secret_lines AS (
  SELECT repo_id, path, k1, i AS k2, name, vals[i] AS v, 1 + {lines_in(f"({before})")} AS line FROM secret_items
)""",
        f"""secrets AS (
  SELECT repo_id, path, 6 AS det, k1, k2, 'critical' AS severity, 'secret' AS category,
    name || ' detected: ' || left(v, 4) || repeat('*', greatest(length(v) - 4, 0)) AS description,
    NULL AS pattern, line, {rules.POINTS_SECRET} AS points
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, v ORDER BY k1, k2) AS seen
        FROM secret_lines WHERE NOT ({marked}))
  WHERE seen = 1
)""",
    ]


SECRETS = _secrets(rules.SECRET_PATTERNS)

_FROM = r"(?i)^\s*FROM\s+(\S+)(?:\s+AS\s+(\S+))?"
_ADD = r"(?i)^\s*ADD\s+(?:--\S+\s+)*(\S+)"
_SECRET_ENV = r"(?i)(?:PASSWORD|SECRET|TOKEN|API_KEY)\w{0,64}(?:\s{0,16}=\s{0,16}|\s{1,16})(\S{8,})"


def _docker() -> list[str]:
    """Over docker(repo_id, path, text)."""

    def lint(k2, category, description, points, where):
        severity = "info" if points == 0 else None
        return f"""SELECT repo_id, path, n AS k1, {k2} AS k2, {sql_text(severity) if severity else 'NULL'} AS severity,
  'dockerfile_{category}' AS category, {description} AS description, n AS line, {points} AS points
FROM from_lines WHERE {where}"""

    suffixes = " OR ".join(f"suffix(src, {sql_text(s)})" for s in rules.ADD_ARCHIVE_SUFFIXES)
    checks = [
        lint(0, "unpinned_base_image", "'Base image not pinned to a specific version: ' || image", 0,
             "image <> '' AND lower(image) <> 'scratch' AND NOT coalesce(first_n < n, false) "
             "AND (NOT contains(image, ':') OR suffix(image, ':latest'))"),
        lint(1, "root_user", "'Explicitly runs as root'", rules.POINTS_ROOT_USER,
             r"regexp_matches(l, '(?i)^\s*USER\s+(root|0)(:\S+)?\b')"),
        lint(2, "add_vs_copy", "'ADD used where COPY would suffice (no auto-extraction/URL fetch needed)'", 0,
             f"src <> '' AND NOT (prefix(src, 'http://') OR prefix(src, 'https://') OR {suffixes})"),
        lint(3, "pipe_to_shell", "'Pipes a remote download directly into a shell'", rules.POINTS_PIPE_TO_SHELL,
             r"regexp_matches(l, '(?i)(curl|wget)\s+.{0,500}\|\s*(sudo\s+)?(sh|bash)\b')"),
        lint(4, "insecure_tls", "'Disables TLS certificate verification'", rules.POINTS_INSECURE_TLS,
             r"regexp_matches(l, '(?i)--no-check-certificate|curl\s+.{0,500}(-k\b|--insecure)')"),
        lint(5, "hardcoded_secret", "'Hardcoded credential in ENV/ARG instruction'", rules.POINTS_HARDCODED_SECRET,
             rf"regexp_matches(regexp_extract(l, '(?i)^\s*(?:ENV|ARG)\s+(.*)$', 1), {sql_text(_SECRET_ENV)})"),
        f"""SELECT repo_id, path, 1000000000 AS k1, 0 AS k2, NULL AS severity, 'dockerfile_root_user' AS category,
  'No USER instruction: container runs as root by default' AS description, NULL AS line, {rules.POINTS_ROOT_USER} AS points
FROM dlines GROUP BY repo_id, path HAVING NOT bool_or(regexp_matches(l, '(?i)^\\s*USER\\s+\\S+'))""",
    ]
    return [
        r"""dlines AS (
  SELECT repo_id, path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS n
  FROM (SELECT repo_id, path, string_split(text, chr(10)) AS ls FROM docker
        WHERE regexp_matches(path, '(^|/)(Dockerfile|Dockerfile\.[^/]*|[^/]*\.dockerfile)$'))
)""",
        f"""stages AS (
  SELECT repo_id, path, lower(regexp_extract(l, {sql_text(_FROM)}, 2)) AS alias, min(n) AS first_n
  FROM dlines WHERE regexp_extract(l, {sql_text(_FROM)}, 2) <> '' GROUP BY ALL
)""",
        f"""from_lines AS (
  SELECT d.*, s.first_n FROM (
    SELECT *, regexp_extract(l, {sql_text(_FROM)}, 1) AS image, regexp_extract(l, {sql_text(_ADD)}, 1) AS src FROM dlines) d
  LEFT JOIN stages s ON s.repo_id = d.repo_id AND s.path = d.path AND s.alias = lower(d.image)
)""",
        f"docker_hits AS (\n{_union(checks)}\n)",
        f"""dockerfile AS (
  SELECT repo_id, path, 7 AS det, k1, k2,
    coalesce(severity, CASE WHEN sum(points) OVER (PARTITION BY repo_id, path) >= {rules.DOCKER_MEDIUM_FROM}
                            THEN 'medium' ELSE 'low' END) AS severity,
    category, description, NULL AS pattern, line, points
  FROM docker_hits
)""",
    ]


DOCKER = _docker()

ENTROPY = [
    f"""entropies AS (
  SELECT repo_id, path, coalesce(list_entropy(regexp_extract_all(hex(encode(text)), '..')), 0) AS entropy FROM docs
)""",
    f"""high_entropy AS (
  SELECT repo_id, path, 0 AS det, 0 AS k1, 0 AS k2, 'medium' AS severity, 'obfuscation' AS category,
    'High entropy: ' || printf('%.2f', entropy) || ' (possible obfuscation)' AS description,
    NULL AS pattern, NULL AS line, {rules.POINTS_ENTROPY} AS points
  FROM entropies WHERE entropy > {rules.HIGH_ENTROPY}
)""",
]

FINDING_COLUMNS = "repo_id, path, severity, category, description, line, points"
TEXT_DETECTORS = ["malicious", "long_line", "dangerous_fn", "encoding", "network", "secrets"]
TEXT_CTES = [*MALICIOUS, *LONG_LINE, *DANGEROUS, *ENCODING, *NETWORK, *SECRETS]


def _found(names: list[str]) -> str:
    return "found AS (\n" + _union([f"SELECT * FROM {n}" for n in names]) + "\n)"


POSITIONED = """positioned AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY det, k1, k2) - 1 AS ord FROM found
)"""


def band(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {floor} THEN '{name}'" for name, floor in rules.BANDS)
    return f"CASE {whens} ELSE 'safe' END"


def label(level: str, labels: dict[str, str]) -> str:
    return f"CASE {level} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in labels.items()) + " END"


SCORES = """scores AS (
  SELECT d.repo_id, d.path, d.ext AS file_type, least(100, coalesce(sum(f.points), 0))::DOUBLE AS risk_score,
    count(f.path) FILTER (f.severity <> 'info') AS n_findings,
    count(f.path) FILTER (f.severity = 'info') AS n_cautions
  FROM docs d LEFT JOIN found f ON f.repo_id = d.repo_id AND f.path = d.path GROUP BY ALL
)"""

DOC_FINDINGS = [corpora.DOCUMENTS_SQL, *TEXT_CTES, *ENTROPY, _found([*TEXT_DETECTORS, "high_entropy"])]
# plain pages and build files cannot reach 7.5 bits per byte; entropy has its own query
PAGE_FINDINGS = [corpora.PAGES_SQL, *TEXT_CTES, *ENTROPY, _found([*TEXT_DETECTORS, "high_entropy"])]


def _one(name: str, *ctes: str) -> str:
    return sql(*ctes, select=f"SELECT {FINDING_COLUMNS} FROM {name}")


# --- paths -----------------------------------------------------------------------

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SUFFIX = f"regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)"
_WANTED = f"""NOT is_symlink
  AND NOT list_has_any(string_split(path, '/')[1:len(string_split(path, '/')) - 1], {sql_list(rules.SKIP_DIRS)})
  AND lower({_SUFFIX}) NOT IN ({", ".join(map(sql_text, rules.SKIP_EXTENSIONS))})
  AND {_NAME} NOT IN ({", ".join(map(sql_text, rules.SKIP_NAMES))})
  AND {" AND ".join(f"NOT suffix({_NAME}, {sql_text(s)})" for s in rules.SKIP_NAME_SUFFIXES)}"""
_IGNORED = f"""EXISTS (SELECT 1 FROM globs g WHERE g.repo_id = paths.repo_id
  AND (regexp_matches(paths.path, g.regex) OR regexp_matches({_NAME.replace('path', 'paths.path')}, g.regex)))"""

_LANG = "CASE " + " ".join(
    f"WHEN lower(file_type) = {sql_text(e)} THEN {sql_text(l)}" for e, l in rules.LANGUAGE_BY_EXTENSION.items()
) + " ELSE 'unknown' END"


# --- dependencies ----------------------------------------------------------------

def _floor_rows() -> str:
    rows = ", ".join(
        f"({sql_text(eco)}, {sql_text(p)}, {sql_text(floor)}, {sql_text(reason)})"
        for eco, packages in rules.VERSION_FLOORS.items() for p, (floor, reason) in packages.items()
    )
    return f"""floors(ecosystem, package, floor, reason) AS (VALUES {rows}),
floor_hits AS (
  SELECT d.repo_id, d.path, d.ord, '' AS advisory, 'medium' AS severity,
    CASE WHEN d.ecosystem = 'npm' THEN 'NPM package ''' || d.package || ''': ' || f.reason
         ELSE 'Python package ''' || d.package || ''' pinned to ' || d.pinned || ': ' || f.reason
              || ' (fixed in ' || f.floor || ')' END AS description,
    d.line, {rules.POINTS_FLOOR} AS points
  FROM deps d JOIN floors f ON f.ecosystem = d.ecosystem AND f.package = d.package
  WHERE d.version < CAST(string_split(f.floor, '.') AS BIGINT[])
)"""


FLOORS = _floor_rows()
ADVISORY = f"""pins AS (
  SELECT * FROM deps WHERE version IS NOT NULL
),
advisory_hits AS (
  SELECT p.repo_id, p.path, p.ord, a.id AS advisory, 'high' AS severity,
    p.ecosystem || ' package ''' || p.package || ''' ' || p.pinned || ': ' || a.id || ' - ' ||
      coalesce(nullif(a.summary, ''), nullif(left(a.details, 120), ''), 'no summary available') AS description,
    p.line, {rules.POINTS_ADVISORY} AS points
  FROM pins p JOIN advisories a ON a.ecosystem = p.ecosystem AND a.package = p.package
  WHERE (a.introduced IS NULL OR p.version >= a.introduced) AND (a.fixed IS NULL OR p.version < a.fixed)
)"""
DEP_CTES = [corpora.MANIFESTS_SQL, corpora.ADVISORIES_SQL, FLOORS, ADVISORY]
DEP_FOUND = """dep_found AS (
  SELECT repo_id, 'dependencies' AS path,
    row_number() OVER (PARTITION BY repo_id ORDER BY path = 'requirements.txt', ord, advisory) - 1 AS ord,
    severity, 'vulnerable_dependency' AS category, description, NULL AS pattern, line, points
  FROM (SELECT * FROM floor_hits UNION ALL SELECT * FROM advisory_hits)
)"""
_DEP_COLUMNS = "repo_id, path, ord, severity, description, line, points"
_ENTRIES = "SELECT repo_id, package, pinned, ord, array_to_string(version, '.') AS version FROM deps WHERE ecosystem = "

# --- the full corpus ---------------------------------------------------------------

_DOCS_BODY = corpora.DOCUMENTS_SQL.strip().removeprefix("docs AS (").removesuffix(")")
FULL_DOCS = f"""doc_files AS ({_DOCS_BODY}),
docs AS (
  SELECT * FROM doc_files
  UNION ALL SELECT repo_id, path, {_SUFFIX}, text FROM docker
  UNION ALL SELECT repo_id, path, '.txt', string_agg(entry, chr(10) ORDER BY line) FROM pip_lines GROUP BY ALL
  UNION ALL SELECT repo_id, path, '.json', string_agg('"' || package || '": "' || spec || '"', chr(10) ORDER BY pos)
            FROM npm_lines GROUP BY ALL
)"""
FULL = [
    corpora.DOCKER_SQL, *DEP_CTES, FULL_DOCS, *TEXT_CTES, *ENTROPY, *DOCKER,
    _found([*TEXT_DETECTORS, "high_entropy", "dockerfile"]), POSITIONED, SCORES, DEP_FOUND,
    """result_findings AS (
  SELECT repo_id, path, ord, severity, category, description, pattern, line FROM positioned
  UNION ALL SELECT repo_id, path, ord, severity, category, description, pattern, line FROM dep_found
)""",
    """results AS (
  SELECT repo_id, path, risk_score, n_findings, n_cautions FROM scores
  UNION ALL SELECT repo_id, path, least(100, sum(points))::DOUBLE, count(*), 0 FROM dep_found GROUP BY ALL
)""",
]


def _rollup(results: str) -> str:
    level = band("risk_score")
    return f"""rollup_ AS (
  SELECT *, {band('overall_risk_score')} AS risk_level FROM (
    SELECT repo_id, count(*) AS total_files, max(risk_score) AS overall_risk_score,
      count(*) FILTER ({level} IN ('critical', 'high')) AS high_risk_files,
      count(*) FILTER ({level} = 'medium') AS medium_risk_files,
      count(*) FILTER ({level} = 'low') AS low_risk_files,
      count(*) FILTER ({level} = 'safe') AS safe_files,
      sum(n_findings)::BIGINT AS findings_count, sum(n_cautions)::BIGINT AS cautions_count
    FROM {results} GROUP BY repo_id)
)"""


CHUNKED = [
    corpora.DOCKER_SQL, f"""doc_files AS ({_DOCS_BODY}),
docs AS (SELECT * FROM doc_files UNION ALL SELECT repo_id, path, {_SUFFIX}, text FROM docker)""",
    *TEXT_CTES, *ENTROPY, *DOCKER, _found([*TEXT_DETECTORS, "high_entropy", "dockerfile"]), POSITIONED,
]
OWN = [
    corpora.DOCUMENTS_SQL, *_malicious(OWN_RULES["malicious"]), _functions(OWN_RULES["dangerous"]),
    *_network(OWN_RULES["network"]), *_secrets(OWN_RULES["secret"]),
    """accent AS (
  SELECT repo_id, path, 9 AS det, 0 AS k1, 0 AS k2, 'low' AS severity, 'accent' AS category,
    'Has an accent' AS description, NULL AS pattern, NULL AS line, 1 AS points
  FROM docs WHERE contains(text, 'ê')
)""",
    _found(["malicious", "dangerous_fn", "network", "secrets", "accent"]), POSITIONED,
]
_POSITIONED_ALL = (
    "SELECT repo_id, path, ord, severity, category, description, pattern, line, points FROM positioned"
)

COUNTS = ("repo_id, total_files, overall_risk_score, risk_level, high_risk_files, medium_risk_files, "
          "low_risk_files, safe_files, findings_count, cautions_count")
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
RANKED = f"""ranked AS (
  SELECT *, severity = 'info' AS is_caution,
    row_number() OVER (PARTITION BY repo_id, severity = 'info' ORDER BY {_RANK}, path, ord) AS rank
  FROM result_findings
)"""
LISTED = f"""listed AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY is_caution, rank) - 1 AS position
  FROM ranked WHERE rank <= {rules.REPORT_LIMIT}
)"""


def _bar(score: str, width: int) -> str:
    filled = f"CAST(floor(greatest(0, least({score}, 100)) / 100 * {width}) AS INT)"
    return f"repeat('#', {filled}) || repeat('-', {width} - {filled})"


def _sarif_level(severity: str) -> str:
    return label(severity, rules.SARIF_LEVELS)


LISTED_ALL = """listed_all AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY is_caution, rank) - 1 AS position FROM ranked
)"""

_SCORE = "(o_totalprice % 13000 / 100)"
_SAMPLE = "regexp_extract_all(left(hex(encode(html)), 1024), '..')"

ORACLES: dict[str, str] = {
    "malicious": _one("malicious", corpora.DOCUMENTS_SQL, *MALICIOUS),
    "long_line": _one("long_line", corpora.DOCUMENTS_SQL, *LONG_LINE),
    "dangerous_fn": _one("dangerous_fn", corpora.DOCUMENTS_SQL, *DANGEROUS),
    "network": _one("network", corpora.DOCUMENTS_SQL, LOWS, *NETWORK),
    "encoding": _one("encoding", corpora.DOCUMENTS_SQL, LOWS, *ENCODING),
    "secrets": _one("secrets", corpora.DOCUMENTS_SQL, *SECRETS),
    "dockerfile": _one("dockerfile", corpora.DOCKER_SQL, *DOCKER),
    "base64_count": sql(corpora.DOCUMENTS_SQL, RUNS, select="SELECT repo_id, path, len(rs) AS n FROM runs"),
    "entropy": sql(
        corpora.DOCUMENTS_SQL, *ENTROPY,
        select=f"SELECT repo_id, path, round(entropy, 6) AS entropy, round(entropy, 6) > {rules.HIGH_ENTROPY} AS is_high FROM entropies"),
    "entropy_sample": f"SELECT page_id, round(coalesce(list_entropy({_SAMPLE}), 0), 6) AS entropy FROM pages",
    "pages_findings": _one("found", *PAGE_FINDINGS),
    "classify": f"""
SELECT CAST(doc_id AS VARCHAR) AS path, is_binary, CASE WHEN NOT is_binary THEN chars END AS chars FROM (
  SELECT doc_id,
    CASE doc_id % 6 WHEN 2 THEN true WHEN 5 THEN true
         WHEN 3 THEN strlen(text) < {rules.BINARY_PROBE_BYTES} ELSE false END AS is_binary,
    CASE doc_id % 6 WHEN 3 THEN length(text) + 4 WHEN 4 THEN 0 ELSE length(text) END AS chars
  FROM documents)""",
    "file_type": sql(corpora.PATHS_SQL, select=f"""
SELECT file_type, {_LANG} AS language, count(*) AS n
FROM (SELECT coalesce(nullif({_SUFFIX}, ''), 'unknown') AS file_type FROM paths) GROUP BY ALL"""),
    "path_filter": sql(corpora.PATHS_SQL, select=f"SELECT repo_id, path, size FROM paths WHERE {_WANTED}"),
    "size_filter": sql(corpora.PATHS_SQL, select=(
        f"SELECT repo_id, path, size FROM paths WHERE {_WANTED} AND size <= {rules.QUICK_MAX_BYTES}")),
    "read_ignore": f"""
SELECT repo_id, trim(l) AS glob FROM (
  SELECT 'repo_' || n_nationkey AS repo_id,
         unnest(string_split({corpora.sql_pick(corpora.IGNORE_TEXTS, 'n_nationkey')}, chr(10))) AS l FROM nation)
WHERE trim(l) <> '' AND NOT prefix(l, '#')""",
    "ignore_anti": sql(corpora.PATHS_SQL, select=f"SELECT repo_id, path FROM paths WHERE NOT {_IGNORED}"),
    "quick_cap": sql(corpora.PATHS_SQL, select=f"""
SELECT repo_id, path FROM (
  SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS r
  FROM paths WHERE {_WANTED} AND size <= {rules.QUICK_MAX_BYTES} AND NOT {_IGNORED})
WHERE r <= {rules.QUICK_MAX_FILES}"""),
    "read_npm": sql(corpora.MANIFESTS_SQL, select=_ENTRIES + "'npm'"),
    "read_pip": sql(corpora.MANIFESTS_SQL, select=_ENTRIES + "'PyPI'"),
    "npm_floor": sql(corpora.MANIFESTS_SQL, FLOORS, select=(
        f"SELECT {_DEP_COLUMNS} FROM floor_hits WHERE path = 'package.json'")),
    "pip_floor": sql(corpora.MANIFESTS_SQL, FLOORS, select=(
        f"SELECT {_DEP_COLUMNS} FROM floor_hits WHERE path = 'requirements.txt'")),
    "advisory": sql(corpora.MANIFESTS_SQL, corpora.ADVISORIES_SQL, ADVISORY, select=f"SELECT {_DEP_COLUMNS} FROM advisory_hits"),
    "dep_score": sql(*DEP_CTES, DEP_FOUND, select=(
        "SELECT repo_id, path, least(100, sum(points))::DOUBLE AS risk_score, count(*) AS n_findings "
        "FROM dep_found GROUP BY ALL")),
    "file_score": sql(*DOC_FINDINGS, SCORES, select=(
        f"SELECT repo_id, path, file_type, risk_score, {band('risk_score')} AS risk_level, n_findings, n_cautions FROM scores")),
    "all_findings": sql(*DOC_FINDINGS, POSITIONED, select=(
        "SELECT repo_id, path, ord, severity, category, description, pattern, line FROM positioned")),
    "caution_split": sql(*DOC_FINDINGS, select=(
        "SELECT severity = 'info' AS is_caution, severity, category, count(*) AS n, "
        "sum(points)::BIGINT AS points FROM found GROUP BY ALL")),
    "band_counts": sql(*FULL, _rollup("results"), select=f"SELECT {COUNTS} FROM rollup_"),
    "repo_summary": sql(*FULL, _rollup("results"), select=f"""
SELECT {COUNTS}, least(findings_count, {rules.REPORT_LIMIT}) AS findings_reported,
  least(cautions_count, {rules.REPORT_LIMIT}) AS cautions_reported,
  {label('risk_level', rules.STATUS)} AS status, {label('risk_level', rules.RECOMMENDATION)} AS recommendation,
  {_bar('overall_risk_score', 20)} AS score_bar, overall_risk_score >= 50 AS threshold_exceeded
FROM rollup_"""),
    "scan_pages": sql(*PAGE_FINDINGS, SCORES, _rollup("scores"), select=f"SELECT {COUNTS} FROM rollup_"),
    "top50": sql(*FULL, RANKED, select=(
        "SELECT repo_id, is_caution, rank, path, ord, severity, category, description, line "
        f"FROM ranked WHERE rank <= {rules.REPORT_LIMIT}")),
    "top10": sql(*FULL, RANKED, _rollup("results"), select=f"""
SELECT r.repo_id, is_caution, rank, CASE WHEN is_caution THEN 'CAUTION' ELSE upper(severity) END AS label,
  path || coalesce(':' || line, '') || ' ' || category || ': ' ||
    CASE WHEN length(description) > 60 THEN left(description, 60) || '...' ELSE description END AS report_line,
  least(CASE WHEN is_caution THEN cautions_count ELSE findings_count END, {rules.DETAIL_LIMIT}) AS shown,
  CASE WHEN is_caution THEN cautions_count ELSE findings_count END AS total
FROM ranked r JOIN rollup_ u ON u.repo_id = r.repo_id WHERE rank <= {rules.DETAIL_LIMIT}"""),
    "gate": sql(*FULL, _rollup("results"), select=(
        "SELECT repo_id, false AS fail_on_none, " + ", ".join(
            f"overall_risk_score >= {floor} AS fail_on_{name}" for name, floor in reversed(rules.BANDS)) + " FROM rollup_")),
    "multi_factor": f"""
SELECT o_orderkey, round(greatest(0, 85 - {_SCORE} * 0.5), 6) AS code_quality,
  round(greatest(0, 100 - {_SCORE}), 6) AS security, round(least(100, {_SCORE} * 0.7), 6) AS obfuscation,
  round(least(100, {_SCORE} * 0.5), 6) AS malicious, {_bar(_SCORE, 10)} AS score_bar,
  {band(_SCORE)} AS risk_level, {label(band(_SCORE), rules.STATUS)} AS status,
  {label(band(_SCORE), rules.RECOMMENDATION)} AS recommendation
FROM orders""",
    "repo_name": """
SELECT s_suppkey, replace(s_name, '#', '.') || (['', '', '', '.io', '.git'])[s_suppkey % 5 + 1] AS repo_name
FROM supplier""",
    "sarif_uri": """
SELECT o_orderkey, (['src/', 'src/lib/', '/etc/', '/tmp/clone10/', 'pkg/'])[o_orderkey % 5 + 1] || o_orderpriority AS uri
FROM orders""",
    "sarif_rules": sql(*FULL, RANKED, LISTED_ALL, select=f"""
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY first_seen) - 1 AS position, rule_id,
  (['note', 'warning', 'error'])[worst + 1] AS level
FROM (SELECT repo_id, category AS rule_id, min(position) AS first_seen,
        max(CASE {_sarif_level('severity')} WHEN 'note' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS worst
      FROM listed_all GROUP BY repo_id, category)"""),
    "csv_rows": sql(*FULL, select="""
SELECT repo_id, ord AS position, path AS "File", line AS "Line", severity AS "Severity", category AS "Category",
  description AS "Description" FROM result_findings"""),
    "findings_export": sql(*FULL, select=f"""
SELECT repo_id, severity = 'info' AS is_caution, {_RANK} AS severity_rank, ord AS position, path AS "File", line AS "Line",
  severity AS "Severity", category AS "Category", description AS "Description", pattern, points
FROM (SELECT repo_id, path, ord, severity, category, description, pattern, line, points FROM positioned
  UNION ALL SELECT repo_id, path, ord, severity, category, description, pattern, line, points FROM dep_found)"""),
    "export_files": sql(*FULL, select=f"""
SELECT format, repo_id, path AS file, line, severity AS level, category, description
FROM result_findings, (VALUES ('csv'), ('json')) f(format) WHERE NOT starts_with(repo_id, 'order_')
UNION ALL SELECT 'sarif', repo_id, replace(path, chr(92), '/'), line, {_sarif_level('severity')}, category, description
FROM result_findings WHERE NOT starts_with(repo_id, 'order_')"""),
    "sarif_log": sql(*FULL, RANKED, LISTED, select=f"""
SELECT repo_id, position, category AS rule_id, {_sarif_level('severity')} AS level, description AS message,
  replace(path, chr(92), '/') AS uri, line FROM listed"""),
    "json_report": sql(*FULL, RANKED, LISTED, _rollup("results"), select="""
SELECT u.repo_id, 'https://git.example.com/' || u.repo_id AS repo_url, total_files, overall_risk_score, risk_level,
  findings_count, cautions_count, position, path AS file, severity, category, description, line
FROM rollup_ u LEFT JOIN listed l ON l.repo_id = u.repo_id"""),
    "oversize": sql(*DOC_FINDINGS, SCORES, "sized AS (SELECT *, length(path) % 3 = 0 AS noted FROM scores)", select="""
SELECT 'whole' AS mode, repo_id, path, risk_score, noted FROM sized
UNION ALL SELECT 'capped', repo_id, path, CASE WHEN noted THEN 0 ELSE risk_score END, noted FROM sized"""),
    "high_entropy": f"""
SELECT source AS repo_id, CAST(doc_id AS VARCHAR) AS path, 'medium' AS severity, 'obfuscation' AS category,
  {rules.POINTS_ENTROPY} AS points
FROM documents
WHERE doc_id % 2 = 0 AND list_entropy(regexp_extract_all(array_to_string(
  list_transform(range(64), lambda i: sha256(doc_id || ':' || i)), ''), '..')) > {rules.HIGH_ENTROPY}""",
    "read_errors": sql(corpora.DOCUMENTS_SQL, select="""
SELECT repo_id, path, 'info' AS severity, 'Error reading file: Permission denied' AS description, 0 AS points
FROM docs WHERE length(path) % 2 = 0"""),
    "read_archives": sql(corpora.ARCHIVES_SQL, select="""
SELECT repo_id, 'texts/' || doc_id || '.txt' AS path, strlen(text) AS size, sha256(text) AS sha256, false AS failed
FROM packed
UNION ALL SELECT DISTINCT 'cut-' || repo_id, '(archive)', 0, NULL, true FROM packed WHERE last"""),
}
ORACLES["stream_scan"] = ORACLES["file_score"]
ORACLES["chunk_scan"] = sql(*CHUNKED, select=_POSITIONED_ALL)
ORACLES["own_rules"] = sql(*OWN, select=_POSITIONED_ALL)
ORACLES["quick_cap_small"] = ORACLES["quick_cap"].replace(f"r <= {rules.QUICK_MAX_FILES}", f"r <= {SMALL_CAP}")
ORACLES["broken_manifests"] = sql(corpora.MANIFESTS_SQL, select="""
SELECT repo_id, package, pinned, ord, line FROM deps
WHERE ecosystem = 'npm' AND CAST(substr(repo_id, 7) AS BIGINT) // 2 % 3 = 1""")
ORACLES["stream_rollup"] = sql(*DOC_FINDINGS, SCORES, _rollup("scores"), select=f"SELECT {COUNTS} FROM rollup_")
ORACLES["counted_losses"] = sql(corpora.DOCUMENTS_SQL, """
lost AS (SELECT repo_id, length(path) % 3 = 0 AS unknown, length(path) % 2 = 0 AS failed FROM docs)""", select="""
SELECT coalesce(repo_id, '(all)') AS repo_id, count(*) AS listed, count(*) FILTER (unknown) AS dropped,
  count(*) FILTER (failed AND NOT unknown) AS failed, count(*) FILTER (NOT unknown) AS results
FROM lost GROUP BY GROUPING SETS ((repo_id), ())""")
ORACLES["stored_scan"] = sql(*DOC_FINDINGS, SCORES, select=f"""
SELECT repo_id, path, file_type, risk_score FROM scores WHERE file_type <> '.md' AND NOT starts_with(path, 'es/')
UNION ALL SELECT DISTINCT repo_id, {sql_text(rules.IGNORE_FILE)}, 'unknown', 0.0 FROM docs""")
