"""Signature catalogues and check-pattern tables (S6, S7, K*).

The literal tables below are FIXED VALUES: they must equal the reference's
signature catalogues and check tables for results to match.  They are small
configuration tables (tens of rows), independent of corpus size.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — built-in line-scan catalogues (id, name, severity,
# description, code patterns).  Patterns are RE2 syntax as written upstream.
# ---------------------------------------------------------------------------
PYTHON_CATALOG = [
    ("PY001", "Dangerous eval() usage", "high",
     "Using eval() can execute arbitrary code and is a security risk",
     [r"eval\s*\([^)]*\)"]),
    ("PY002", "Dangerous exec() usage", "high",
     "Using exec() can execute arbitrary code and is a security risk",
     [r"exec\s*\([^)]*\)"]),
    ("PY003", "Insecure pickle usage", "high",
     "Using pickle with untrusted data can lead to arbitrary code execution",
     [r"pickle\.loads\s*\([^)]*\)", r"pickle\.load\s*\([^)]*\)"]),
    ("PY004", "SQL Injection risk", "high",
     "String formatting in SQL queries can lead to SQL injection",
     [r"execute\s*\(['\"][^'\"]*%[^'\"]*['\"]",
      r"execute\s*\(['\"][^'\"]*\{\s*[^}]*\}[^'\"]*['\"]\.format",
      r"execute\s*\(['\"][^'\"]*\+[^'\"]*['\"]"]),
    ("PY005", "Insecure random number generation", "medium",
     "Using random module for security purposes is not recommended",
     [r"random\.(?:random|randint|choice|randrange)"]),
    ("PY006", "Hardcoded credentials", "high",
     "Hardcoded credentials are a security risk",
     [r"password\s*=\s*['\"][^'\"]{3,}['\"]",
      r"passwd\s*=\s*['\"][^'\"]{3,}['\"]",
      r"pwd\s*=\s*['\"][^'\"]{3,}['\"]",
      r"secret\s*=\s*['\"][^'\"]{3,}['\"]",
      r"api_key\s*=\s*['\"][^'\"]{3,}['\"]"]),
    ("PY007", "Insecure hash function", "medium",
     "Using weak hash functions like MD5 or SHA1",
     [r"hashlib\.md5", r"hashlib\.sha1"]),
    ("PY008", "Temporary file creation risk", "medium",
     "Insecure temporary file creation can lead to race conditions",
     [r"open\s*\(['\"][^'\"]*\/tmp[^'\"]*['\"]", r"tempfile\.mktemp"]),
    ("PY009", "Insecure deserialization", "high",
     "Deserializing untrusted data can lead to arbitrary code execution",
     [r"yaml\.load\s*\([^)]*\)", r"json\.loads\s*\([^)]*\)"]),
    ("PY010", "Debug mode enabled", "medium",
     "Running applications in debug mode can expose sensitive information",
     [r"debug\s*=\s*True", r"app\.run\s*\([^)]*debug\s*=\s*True[^)]*\)"]),
]

JAVASCRIPT_CATALOG = [
    ("JS001", "Dangerous eval() usage", "high",
     "Using eval() can execute arbitrary code and is a security risk",
     [r"eval\s*\([^)]*\)"]),
    ("JS002", "Dangerous Function() constructor", "high",
     "Using Function() constructor can execute arbitrary code and is a security risk",
     [r"new\s+Function\s*\([^)]*\)", r"Function\s*\([^)]*\)"]),
    ("JS003", "DOM-based XSS risk", "high",
     "Manipulating innerHTML with user input can lead to XSS",
     [r"\.innerHTML\s*=", r"\.outerHTML\s*=", r"document\.write\s*\(", r"document\.writeln\s*\("]),
    ("JS004", "Insecure random number generation", "medium",
     "Using Math.random() for security purposes is not recommended",
     [r"Math\.random\s*\(\)"]),
    ("JS005", "Hardcoded credentials", "high",
     "Hardcoded credentials are a security risk",
     [r"password\s*=\s*['\"][^'\"]{3,}['\"]",
      r"passwd\s*=\s*['\"][^'\"]{3,}['\"]",
      r"pwd\s*=\s*['\"][^'\"]{3,}['\"]",
      r"secret\s*=\s*['\"][^'\"]{3,}['\"]",
      r"apiKey\s*=\s*['\"][^'\"]{3,}['\"]"]),
    ("JS006", "Insecure HTTP protocol", "medium",
     "Using HTTP instead of HTTPS can expose data to eavesdropping",
     [r"http:\/\/[^'\"]*['\"]"]),
    ("JS007", "Potential prototype pollution", "high",
     "Modifying Object.prototype can lead to prototype pollution vulnerabilities",
     [r"Object\.prototype\.[^=]+=", r"__proto__\.[^=]+="]),
    ("JS008", "Insecure JWT verification", "high",
     "Not verifying JWT signatures can lead to authentication bypass",
     [r"jwt\.verify\s*\([^,]*,\s*['\"]?none['\"]?[^)]*\)"]),
    ("JS009", "Insecure cookie settings", "medium",
     "Cookies without secure or httpOnly flags can be vulnerable to theft",
     [r"document\.cookie\s*=\s*[^;]*(?!secure|httpOnly)",
      r"\.cookie\s*\([^)]*(?!secure|httpOnly)[^)]*\)"]),
    ("JS010", "Debug mode enabled", "medium",
     "Running applications in debug mode can expose sensitive information",
     [r"debug\s*:\s*true", r"debugMode\s*=\s*true"]),
]

# Whole-file block checks: (id, name, severity, description, pattern,
# confidence, suffix appended to the matched text).
PYTHON_BLOCK_CHECKS = [
    ("PY011", "Empty except block", "medium",
     "Empty except blocks can hide errors and make debugging difficult",
     r"(?m)^(\s*)except(\s+\w+)?:\s*$", 0.85, ""),
    ("PY012", "Bare except block", "medium",
     "Bare except blocks can catch unexpected exceptions and hide errors",
     r"(?m)^(\s*)except:\s*", 0.9, ""),
]
JAVASCRIPT_BLOCK_CHECKS = [
    ("JS011", "Console logging in production", "low",
     "Console logging should be removed from production code",
     r"console\.log\s*\(", 0.7, "...)"),
    ("JS012", "Alert in production", "low",
     "Alert dialogs should be removed from production code",
     r"alert\s*\(", 0.7, "...)"),
]

# Languages each built-in detector claims, in registration order (A10).
DETECTOR_LANGUAGES = {
    "python": ["python", "py"],
    "javascript": ["javascript", "js", "jsx", "ts", "tsx"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES — the CWE signature file (Python CLI format).
# ---------------------------------------------------------------------------
CWE_SIGNATURES = {
    "signatures": [
        {
            "id": "CWE-78",
            "name": "OS Command Injection",
            "description": "The software constructs all or part of an OS command using externally-influenced input from an upstream component, but it does not neutralize or incorrectly neutralizes special elements that could modify the intended OS command when it is sent to a downstream component.",
            "severity": "CRITICAL",
            "cwe_id": "CWE-78",
            "affected_languages": ["python", "php", "javascript"],
            "code_patterns": [r"os\.system\(.*\)", r"subprocess\.call\(.*shell\s*=\s*True.*\)", r"exec\(.*\)", r"eval\(.*\)"],
            "fix_patterns": ["shlex.quote(command)", "subprocess.run([command], shell=False)", "ast.literal_eval(input)"],
            "context_patterns": [r"import\s+os", r"import\s+subprocess", r"import\s+shlex"],
        },
        {
            "id": "CWE-89",
            "name": "SQL Injection",
            "description": "The software constructs all or part of an SQL command using externally-influenced input from an upstream component, but it does not neutralize or incorrectly neutralizes special elements that could modify the intended SQL command when it is sent to a downstream component.",
            "severity": "CRITICAL",
            "cwe_id": "CWE-89",
            "affected_languages": ["python", "php", "java"],
            "code_patterns": [r"cursor\.execute\(.*%.*\)", r"cursor\.execute\(.*\+.*\)", r"cursor\.executemany\(.*%.*\)", r"mysql_query\(.*\$.*\)"],
            "fix_patterns": ["cursor.execute(query, params)", "cursor.executemany(query, params)", "prepared_statement.setString(1, input)"],
            "context_patterns": [r"import\s+sqlite3", r"import\s+mysql", r"import\s+psycopg2"],
        },
        {
            "id": "CWE-22",
            "name": "Path Traversal",
            "description": "The software uses external input to construct a pathname that is intended to identify a file or directory that is located underneath a restricted parent directory, but the software does not properly neutralize special elements within the pathname that can cause the pathname to resolve to a location that is outside of the restricted directory.",
            "severity": "HIGH",
            "cwe_id": "CWE-22",
            "affected_languages": ["python", "php", "java", "javascript"],
            "code_patterns": [r"open\(.*\+.*\)", r"file_get_contents\(.*\$.*\)", r"new\s+File\(.*\+.*\)"],
            "fix_patterns": ["os.path.abspath(os.path.join(base_dir, filename))", "os.path.normpath(path)", "Path(path).resolve().is_relative_to(base_dir)"],
            "context_patterns": [r"import\s+os", r"from\s+pathlib\s+import\s+Path"],
        },
        {
            "id": "CWE-79",
            "name": "Cross-site Scripting (XSS)",
            "description": "The software does not neutralize or incorrectly neutralizes user-controllable input before it is placed in output that is used as a web page that is served to other users.",
            "severity": "HIGH",
            "cwe_id": "CWE-79",
            "affected_languages": ["python", "php", "javascript"],
            "code_patterns": [r"innerHTML\s*=.*", r"document\.write\(.*\)", r"\$\(.*\)\.html\(.*\)"],
            "fix_patterns": ["textContent = content", "innerText = content", "createElement('div')"],
            "context_patterns": ["<script>", r"document\.", r"\$\("],
        },
        {
            "id": "CWE-200",
            "name": "Information Exposure",
            "description": "The software exposes sensitive information to an actor that is not explicitly authorized to have access to that information.",
            "severity": "MEDIUM",
            "cwe_id": "CWE-200",
            "affected_languages": ["python", "php", "java", "javascript"],
            "code_patterns": [r"print\(.*exception.*\)", r"console\.log\(.*error.*\)", r"printStackTrace\(\)"],
            "fix_patterns": ["logger.error(str(e))", "log.error('Error occurred', exc_info=True)", "console.error('Error:', error.message)"],
            "context_patterns": [r"try\s*:", r"catch\s*\(", r"except\s+"],
        },
    ]
}

# ---------------------------------------------------------------------------
# FIXED VALUES — the example signature file of the Go signature detector
# (id, name, severity, code patterns); severities are the Chinese labels.
# ---------------------------------------------------------------------------
GO_SIGNATURES = [
    ("CWE-78", "OS命令注入", "高", [r"os\.system\(.*\)", r"exec\.Command\(.*\)", r"shell\.Run\(.*\)"]),
    ("CWE-89", "SQL注入", "高", [r"db\.Query\(.*\+.*\)", r"db\.Exec\(.*\+.*\)", r"sql\.Raw\(.*\)"]),
    ("CWE-200", "敏感信息泄露", "中", [r"log\.Print\(.*password.*\)", r"fmt\.Printf\(.*secret.*\)",
                                  r"\.Debug\(.*key.*\)"]),
    ("CWE-22", "路径遍历", "高", [r"os\.Open\(.*\)", r"ioutil\.ReadFile\(.*\)", r"os\.ReadFile\(.*\)"]),
    ("CWE-326", "弱加密", "中", [r"md5\.New\(\)", r"sha1\.New\(\)", r"des\.NewCipher\(.*\)"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — static security-check pattern tables, per dialect.
# check -> patterns.  "python" patterns run with Python semantics, "go" with RE2.
# ---------------------------------------------------------------------------
SECURITY_PATTERNS = {
    "python": {
        "file_access": [r"open\s*\([^)]*['\"]\/(?:etc|root|home|usr|var)[^'\"]*['\"]\s*\)",
                        r"os\.(?:remove|unlink|rmdir|mkdir|chmod|chown)"],
        "network_access": [r"socket\.(?:socket|connect|bind|listen)",
                           r"urllib\.(?:request|urlopen)",
                           r"requests\.(?:get|post|put|delete)"],
        "code_execution": [r"(?:exec|eval|subprocess\.(?:call|Popen|run))",
                           r"os\.(?:system|popen|spawn)"],
        "input_validation": [r"input\s*\(", r"raw_input\s*\(", r"eval\s*\("],
        "random_generation": [r"random\.(?:random|randint|choice|randrange)",
                              r"secrets\.(?:token_hex|token_bytes|token_urlsafe)"],
        "sensitive_data": [r"(?:password|secret|key|token|credential)",
                           r"print\s*\([^)]*(?:password|secret|key|token)[^)]*\)"],
        "memory_usage": [r"list\s*\(.*\)", r"\[\s*.*\s*for\s.*\]", r"dict\s*\(.*\)"],
        "execution_time": [r"while\s+True:", r"time\.sleep\s*\(", r"for\s+.*\s+in\s+range\s*\(\s*\d+\s*\)"],
    },
    "go": {
        "file_access": [r"os\.(Open|Create|Remove|RemoveAll|Chmod|Chown)", r"ioutil\.(ReadFile|WriteFile)"],
        "network_access": [r"net\.(Dial|Listen)", r"http\.(Get|Post|Put|Delete)"],
        "code_execution": [r"exec\.(Command|Run)", r"syscall\.(Exec|StartProcess)"],
        "input_validation": [r"fmt\.(Scan|Scanf|Scanln)", r"bufio\.NewScanner"],
        "random_generation": [r"math/rand\.(Int|Float|Perm)", r"crypto/rand\.(Read|Prime)"],
        "sensitive_data": [r"(?i)(password|secret|key|token|credential)", r"fmt\.Printf.*password"],
    },
}
# Match texts containing this marker are not reported by the random check.
RANDOM_SAFE_MARKER = {"python": "secrets", "go": "crypto/rand"}
# Checks that are pattern scans (the call-based checks K5/K6 use call sites).
PATTERN_CHECKS = ["file_access", "network_access", "random_generation", "sensitive_data",
                  "memory_usage", "execution_time"]

# FIXED VALUES — call-site checks (K5, K6).
INPUT_CALL_NAMES = ["input", "raw_input"]
HTTP_ATTRIBUTE_CALLS = ["get", "post", "put", "delete"]
SANDBOX_ATTRIBUTE_CALLS = ["system", "popen", "spawn", "call", "Popen", "run"]
SANDBOX_NAME_CALLS = ["exec", "eval"]

# FIXED VALUES — severity scale (T12).  Upper/lower-case English and the
# Chinese high/medium/low labels map to one lower-case scale.
SEVERITY_SCALE = [
    ("CRITICAL", "critical", 4), ("HIGH", "high", 3), ("MEDIUM", "medium", 2), ("LOW", "low", 1),
    ("critical", "critical", 4), ("high", "high", 3), ("medium", "medium", 2), ("low", "low", 1),
    ("高", "high", 3), ("中", "medium", 2), ("低", "low", 1),
]

# FIXED VALUES — extension -> language.
EXTENSION_LANGUAGE = [
    (".py", "python"), (".java", "java"), (".cpp", "cpp"), (".hpp", "cpp"), (".cc", "cpp"),
    (".hh", "cpp"), (".c", "c"), (".h", "c"), (".go", "go"), (".js", "javascript"),
    (".jsx", "javascript"), (".ts", "javascript"), (".tsx", "javascript"),
]

SIGNATURE_SCHEMA = T.StructType([
    T.StructField("sig_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("cwe_id", T.StringType()),
    T.StructField("cve_id", T.StringType()),
    T.StructField("affected_languages", T.ArrayType(T.StringType())),
    T.StructField("code_patterns", T.ArrayType(T.StringType())),
    T.StructField("fix_patterns", T.ArrayType(T.StringType())),
    T.StructField("context_patterns", T.ArrayType(T.StringType())),
])


def builtin_signatures(spark: SparkSession, language: str = "python") -> DataFrame:
    """A built-in catalogue as a ``signatures`` DataFrame."""
    cat = {"python": PYTHON_CATALOG, "javascript": JAVASCRIPT_CATALOG}[language]
    langs = DETECTOR_LANGUAGES[language]
    rows = [(i, n, s, d, None, None, langs, list(p), [], []) for i, n, s, d, p in cat]
    return spark.createDataFrame(rows, SIGNATURE_SCHEMA)


def cwe_signatures(spark: SparkSession) -> DataFrame:
    """The CWE signature file as a DataFrame (``load_signatures`` without ``references``)."""
    rows = [_signature_row(s) for s in CWE_SIGNATURES["signatures"]]
    return spark.createDataFrame(rows, SIGNATURE_SCHEMA)


def _signature_row(s: dict) -> tuple:
    return (s["id"], s["name"], s.get("severity", "UNKNOWN"), s.get("description", ""),
            s.get("cwe_id"), s.get("cve_id"), s.get("affected_languages", []),
            s.get("code_patterns", []), s.get("fix_patterns", []), s.get("context_patterns", []))


def load_signatures(spark: SparkSession, path: str) -> DataFrame:
    """JSON ``{signatures: [...]}`` with per-field defaults.

    Read with Spark's JSON source (multiLine) and an explicit schema, then
    explode the array; missing fields get the reference defaults.
    """
    arr = T.ArrayType(T.StringType())
    sig = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("severity", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("cwe_id", T.StringType()), T.StructField("cve_id", T.StringType()),
        T.StructField("affected_languages", arr), T.StructField("code_patterns", arr),
        T.StructField("fix_patterns", arr), T.StructField("context_patterns", arr),
        T.StructField("references", arr),
    ])
    schema = T.StructType([T.StructField("signatures", T.ArrayType(sig))])
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    empty = F.array().cast(arr)
    return (raw.select(F.explode("signatures").alias("s"))
            .select(F.col("s.id").alias("sig_id"), F.col("s.name").alias("name"),
                    F.coalesce("s.severity", F.lit("UNKNOWN")).alias("severity"),
                    F.coalesce("s.description", F.lit("")).alias("description"),
                    F.col("s.cwe_id").alias("cwe_id"), F.col("s.cve_id").alias("cve_id"),
                    F.coalesce("s.affected_languages", empty).alias("affected_languages"),
                    F.coalesce("s.code_patterns", empty).alias("code_patterns"),
                    F.coalesce("s.fix_patterns", empty).alias("fix_patterns"),
                    F.coalesce("s.context_patterns", empty).alias("context_patterns"),
                    F.coalesce("s.references", empty).alias("references")))


def write_signatures(spark: SparkSession, signatures: dict, path: str) -> None:
    """Write a signature file (any Spark-readable filesystem)."""
    from ..session import write_text_file
    write_text_file(spark, path, json.dumps(signatures))


def patterns_of(signatures: DataFrame) -> DataFrame:
    """Explode ``code_patterns`` to one row per (sig_id, pattern_ord, pattern)."""
    return (signatures.select("sig_id", "name", "severity",
                              F.posexplode("code_patterns").alias("pattern_ord", "pattern")))


def block_checks(spark: SparkSession, language: str) -> DataFrame:
    rows = {"python": PYTHON_BLOCK_CHECKS, "javascript": JAVASCRIPT_BLOCK_CHECKS}[language]
    return spark.createDataFrame(
        rows, "sig_id string, name string, severity string, description string, pattern string, "
              "confidence double, suffix string")


def severity_scale(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEVERITY_SCALE, "severity string, severity_norm string, severity_rank int")


def extension_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXTENSION_LANGUAGE, "ext string, language string")


def supported_languages(spark: SparkSession, detectors=("python", "javascript")) -> DataFrame:
    """A10: concatenated language list of registered detectors, in order."""
    langs = [(d, lang) for d in detectors for lang in DETECTOR_LANGUAGES[d]]
    rows = [(d, lang, i + 1) for i, (d, lang) in enumerate(langs)]
    return spark.createDataFrame(rows, "detector string, language string, ord int")


def validate_patterns(patterns: DataFrame, dialect: str = "python"):
    """Split a patterns table of any size into ``(usable, rejects)``.

    An invalid column pattern would fail the whole Spark job, so every pattern
    is compiled with the scan's regex engine in the tasks; invalid ones and
    ones that can match the empty string go to ``rejects`` with the reason
    (the reference skips them).
    """
    from ..functions.regex import with_reasons

    judged = with_reasons(patterns, dialect)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
