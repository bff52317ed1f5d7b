"""Detection rules and scoring constants.

Fixed values: everything in this module must equal the published rule set for
results to be comparable (patterns, word lists, floors, points, bands).
"""

# --- Malicious patterns: category -> regexes, matched case-insensitively -------
# Gaps are bounded on purpose: an open-ended ``.*`` is quadratic on one huge line.
MALICIOUS_PATTERNS = {
    "crypto_miner": [
        r"cryptonight", r"stratum", r"mining", r"cpuminer",
        r"xmrig", r"minerd", r"cgminer", r"ethminer",
    ],
    "backdoor": [
        r"socket\.bind", r"socket\.connect", r"base64\.b64decode",
        r"exec\(", r"eval\(", r"__import__", r"subprocess\.call",
        r"os\.system", r"requests\.get.{0,200}post", r"urllib.{0,200}urlopen",
    ],
    "data_exfiltration": [
        r"requests\.post.{0,200}data", r"urllib.{0,200}urlopen.{0,200}data",
        r"smtplib", r"email\.send", r"telegram.{0,200}bot",
        r"discord.{0,200}webhook", r"slack.{0,200}webhook",
    ],
    "obfuscation": [
        r"base64\.b64encode", r"base64\.b64decode",
        r"zlib\.compress", r"zlib\.decompress",
        r"__import__.{0,200}base64", r"exec\(.{0,200}decode",
    ],
    "shell_commands": [r"subprocess\.", r"os\.popen", r"popen", r"system\("],
}

# --- Network use: (regex, description), in report order ------------------------
NETWORK_PATTERNS = [
    (r"requests\.(get|post|put|delete|patch)", "HTTP request"),
    (r"socket\.connect", "Socket connection"),
    (r"urllib\.(request|urlopen)", "URL request"),
    (r"ftp\.connect", "FTP connection"),
    (r"websocket", "WebSocket connection"),
]

# --- Dangerous functions: language -> case-sensitive substrings ----------------
DANGEROUS_FUNCTIONS = {
    "python": ["exec", "eval", "compile", "__import__", "os.system",
               "subprocess.call", "subprocess.Popen", "os.popen"],
    "javascript": ["eval", "Function", "setTimeout", "setInterval",
                   "document.write", "innerHTML"],
    "bash": ["exec", "eval", "source", "export", "alias"],
    "php": ["eval", "system", "exec", "passthru", "shell_exec", "assert"],
}

LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript",
    ".ts": "javascript", ".tsx": "javascript", ".sh": "bash",
    ".bash": "bash", ".zsh": "bash", ".php": "php", ".rb": "ruby",
    ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c",
    ".hpp": "cpp", ".java": "java",
}

# --- Secrets: name -> regex with the credential in group 1 ---------------------
SECRET_PATTERNS = {
    "AWS Access Key ID": r"(AKIA[0-9A-Z]{16})",
    "AWS Secret Access Key": r"aws_secret_access_key\s*=\s*[\"']?([A-Za-z0-9/+=]{40})[\"']?",
    "GitHub Token": r"(gh[pousr]_[A-Za-z0-9]{36,255})",
    "GitLab Token": r"(glpat-[A-Za-z0-9\-_]{20})",
    "Slack Token": r"(xox[baprs]-[A-Za-z0-9-]{10,72})",
    "Slack Webhook": r"(https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,})",
    "Google API Key": r"(AIza[0-9A-Za-z\-_]{35})",
    "Stripe Key": r"((?:sk|pk)_(?:live|test)_[0-9a-zA-Z]{24,})",
    "Private Key Block": r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)",
    "JWT": r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    "Generic API Key Assignment": r"(?i)api[_-]?key\s*[:=]\s*[\"']([A-Za-z0-9_\-]{20,})[\"']",
    "Generic Secret Assignment": r"(?i)(?:secret|token)\s*[:=]\s*[\"']([A-Za-z0-9_\-]{20,})[\"']",
    "Hardcoded Password": r"(?i)password\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']",
    "Twilio API Key": r"(SK[0-9a-fA-F]{32})",
    "SendGrid API Key": r"(SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43})",
}

# A value holding one of these (compared in lower case) is documentation, not a secret.
SECRET_PLACEHOLDERS = (
    "example", "changeme", "placeholder", "xxxxxx", "your_", "your-",
    "<", "dummy", "fake", "test_key", "sample",
)

# --- Encoded payloads ----------------------------------------------------------
BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
BASE64_MIN_ENTROPY = 4.5
BASE64_FEW = 2
BASE64_MANY = 5
# (lower-case literal, description, points)
BASE64_CALLS = [
    ("base64.b64decode", "base64 decode function found", 10),
    ("base64.b64encode", "base64 encode function found", 5),
]

# --- Limits --------------------------------------------------------------------
LONG_LINE = 500
EXTREMELY_LONG_LINE = 1000
HIGH_ENTROPY = 7.5
MAX_FILE_MB = 50
MAX_FILE_BYTES = MAX_FILE_MB * 1024 * 1024
QUICK_MAX_BYTES = 1024 * 1024
QUICK_MAX_FILES = 10_000
BINARY_PROBE_BYTES = 1024
REPORT_LIMIT = 50
DETAIL_LIMIT = 10

# --- Path filters --------------------------------------------------------------
SKIP_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv",
             "dist", "build", ".idea", ".vscode"]
SKIP_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico",
                   ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".pdf",
                   ".zip", ".tar", ".gz", ".rar", ".7z"]
SKIP_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock",
              "Pipfile.lock", "Cargo.lock", "composer.lock", "go.sum", "Gemfile.lock"]
SKIP_NAME_SUFFIXES = [".min.js", ".min.css"]
IGNORE_FILE = ".reposecurityignore"
SCAN_MODES = ("quick", "balanced", "thorough", "smart")

# --- Points --------------------------------------------------------------------
POINTS_PATTERN = 5
POINTS_FUNCTION = 3
POINTS_ENTROPY = 20
POINTS_BASE64_FEW = 5
POINTS_BASE64_MANY = 10
POINTS_SECRET = 80
POINTS_FLOOR = 15
POINTS_ADVISORY = 20
POINTS_ROOT_USER = 10
POINTS_PIPE_TO_SHELL = 20
POINTS_INSECURE_TLS = 10
POINTS_HARDCODED_SECRET = 15
MAX_SCORE = 100

# A file's malicious / base64 findings become medium above this many points, and
# its container-build findings from this many points on.
MEDIUM_ABOVE = 20
DOCKER_MEDIUM_FROM = 20

# --- Container build files -----------------------------------------------------
ADD_ARCHIVE_SUFFIXES = [".tar", ".tar.gz", ".tgz", ".tar.bz2", ".zip"]

# --- Dependency floors: ecosystem -> package -> (first good version, reason) ---
NPM = "npm"
PYPI = "PyPI"
NPM_MANIFEST = "package.json"
PIP_MANIFEST = "requirements.txt"
DEPENDENCY_PATH = "dependencies"
VERSION_FLOORS = {
    NPM: {
        "crypto-js": ("4.2.0", "Known cryptographic vulnerabilities"),
        "node-fetch": ("2.6.7", "SSRF vulnerabilities in older versions"),
        "axios": ("0.21.2", "Prototype pollution risks"),
        "lodash": ("4.17.21", "Prototype pollution vulnerabilities"),
        "request": ("9999.0.0", "Deprecated with known issues"),
    },
    PYPI: {
        "requests": ("2.31.0", "SSL/TLS vulnerabilities in older versions"),
        "urllib3": ("1.26.18", "Security issues in older versions"),
        "paramiko": ("2.10.1", "Authentication bypass in some versions"),
        "cryptography": ("39.0.1", "Padding oracle vulnerabilities"),
        "pyyaml": ("5.4", "Arbitrary code execution in vulnerable versions"),
    },
}

# --- Severities, bands, report labels ------------------------------------------
CAUTION = "info"
CAUTION_CATEGORIES = [
    "long_line", "network", "size", "error",
    "dockerfile_unpinned_base_image", "dockerfile_add_vs_copy",
]
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
OTHER_SEVERITY_RANK = 4
BANDS = [("critical", 75), ("high", 50), ("medium", 25), ("low", 10)]
SAFE = "safe"
STATUS = {
    "safe": "SAFE", "low": "LOW RISK", "medium": "MEDIUM RISK",
    "high": "HIGH RISK", "critical": "CRITICAL",
}
RECOMMENDATION = {
    "safe": "SAFE TO CLONE", "low": "REVIEW BEFORE CLONING",
    "medium": "EXERCISE CAUTION", "high": "AVOID CLONING",
    "critical": "DO NOT CLONE",
}
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning",
                "low": "note", "info": "note"}
SARIF_LEVEL_RANK = {"note": 0, "warning": 1, "error": 2}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
