"""Word lists, suffixes and weights that define the results."""

from __future__ import annotations

# Synonyms by key word, in table order.
SYNONYMS: dict[str, list[str]] = {
    "auth": ["authentication", "authorize", "authorization", "login", "signin", "sign_in", "logout", "signout", "sign_out", "session", "jwt", "oauth", "token", "credential", "password", "principal", "identity"],
    "login": ["auth", "authenticate", "signin", "sign_in", "logon", "log_on"],
    "logout": ["signout", "sign_out", "logoff", "log_off", "revoke"],
    "permission": ["rbac", "role", "access", "authorize", "acl", "policy", "scope"],
    "db": ["database", "query", "sql", "orm", "model", "migration", "schema", "table", "postgres", "mysql", "sqlite", "mongo", "redis"],
    "query": ["select", "insert", "update", "delete", "find", "filter", "where", "join"],
    "migration": ["migrate", "alembic", "schema", "alter", "evolve"],
    "cache": ["redis", "memcache", "memoize", "invalidate", "ttl", "expire"],
    "api": ["endpoint", "route", "handler", "controller", "request", "response", "rest", "graphql", "grpc"],
    "endpoint": ["route", "path", "url", "handler", "view", "controller"],
    "request": ["req", "http", "fetch", "call", "invoke"],
    "response": ["res", "reply", "result", "output"],
    "middleware": ["interceptor", "hook", "filter", "pipe", "guard"],
    "test": ["spec", "unittest", "pytest", "jest", "mocha", "assert", "expect", "mock", "stub", "fixture", "snapshot"],
    "mock": ["stub", "fake", "spy", "patch", "monkeypatch"],
    "config": ["settings", "env", "environment", "dotenv", "configuration", "options", "preferences", "params", "parameters"],
    "env": ["environment", "dotenv", "config", "settings", "variable"],
    "error": ["exception", "raise", "throw", "catch", "try", "except", "finally", "fault", "failure", "crash", "panic"],
    "log": ["logger", "logging", "print", "debug", "info", "warn", "error", "trace", "console", "stdout"],
    "async": ["await", "promise", "future", "coroutine", "concurrent", "parallel", "thread", "worker", "task", "background"],
    "queue": ["job", "worker", "celery", "rabbitmq", "kafka", "pub", "sub", "message", "event", "dispatch"],
    "list": ["array", "slice", "vector", "collection", "items"],
    "map": ["dict", "dictionary", "hash", "object", "record", "hashmap"],
    "parse": ["deserialize", "decode", "unmarshal", "read", "load", "from_json", "from_str"],
    "serialize": ["encode", "marshal", "dump", "to_json", "to_str", "format"],
    "file": ["path", "directory", "folder", "read", "write", "stream", "io", "fs"],
    "upload": ["multipart", "form_data", "attachment", "blob", "file"],
    "download": ["fetch", "stream", "export", "save"],
    "component": ["widget", "element", "view", "template", "render"],
    "style": ["css", "theme", "design", "layout", "tailwind", "styled"],
    "state": ["store", "redux", "context", "reactive", "signal", "ref"],
    "event": ["handler", "listener", "callback", "on_click", "on_change", "emit"],
    "deploy": ["release", "publish", "ship", "ci", "cd", "pipeline", "build"],
    "container": ["docker", "kubernetes", "k8s", "pod", "image"],
}

# Directories and suffixes that a source walk leaves out, and its limits.
SKIP_DIRS = ["node_modules", ".pnpm", "bower_components", ".venv", "venv", "env", "site-packages", "__pycache__", ".eggs", ".egg-info", ".tox", ".nox", "dist", "build", ".next", ".nuxt", ".output", ".turbo", "target", ".gradle", ".mvn", ".git", ".svn", ".hg", ".idea", ".vscode", ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", ".coverage", "htmlcov", "Pods", ".dart_tool", ".pub-cache", "ephemeral", "Generated", "DerivedData", ".terraform", ".serverless", "vendor", ".env", ".cache", "tmp", ".temp"]
SKIP_SUFFIXES = [".pyc", ".pyo", ".so", ".dylib", ".dll", ".exe", ".o", ".a", ".class", ".jar", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".bmp", ".tiff", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flac", ".ogg", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".pptx", ".db", ".sqlite", ".sqlite3", ".lock", ".sum", ".map", ".pbxproj", ".xcworkspacedata", ".plist", ".storyboard", ".xib", ".csv", ".parquet", ".pickle", ".pkl", ".npy", ".db-shm", ".db-wal", ".db-journal", ".pem", ".cer", ".crt", ".key", ".p12", ".jks", ".apk", ".ipa", ".aab", ".dex", ".xcscheme", ".gradle", ".gradlew", ".bin", ".dat", ".raw"]
MAX_FILE_SIZE = 100_000
PRIORITY_FILES = ["CLAUDE.md", "AGENTS.md", "README.md", "readme.md", "CONTRIBUTING.md", "ARCHITECTURE.md"]
PRIORITY_PARTS = ["src", "app", "lib"]

# Language by suffix.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".cs": "csharp",
    ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".sc": "scala",
    ".dart": "dart",
    ".lua": "lua",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".ex": "elixir", ".exs": "elixir",
    ".hs": "haskell",
    ".sql": "sql",
    ".md": "markdown", ".mdx": "markdown",
    ".rst": "rst",
    ".txt": "text",
    ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml",
    ".json": "json",
    ".xml": "xml",
    ".html": "html", ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".less": "less",
    ".vue": "vue",
    ".svelte": "svelte",
    ".ipynb": "jupyter",
}

# What marks a test file, by language.
TEST_PATTERNS = {
    "python": ["test_", "_test.py", "conftest.py"], "javascript": [".test.", ".spec.", "__tests__/"], "typescript": [".test.", ".spec.", "__tests__/"],
    "go": ["_test.go"], "rust": ["tests/", "_test.rs"], "java": ["Test.java", "Tests.java", "test/"], "csharp": ["Test.cs", "Tests.cs"],
    "ruby": ["_test.rb", "_spec.rb", "test/", "spec/"], "php": ["Test.php", "test/", "tests/"], "swift": ["Tests.swift", "Test.swift", "Tests/"],
    "kotlin": ["Test.kt", "Tests.kt", "test/"], "dart": ["_test.dart", "test/"], "scala": ["Spec.scala", "Test.scala", "Suite.scala"], "elixir": ["_test.exs", "test/"],
}

# Sensitive words of paths, technologies, ranking weights.
SECURITY = ["auth", "login", "token", "jwt", "oauth", "session", "password", "secret", "key", "encrypt", "decrypt", "hash", "credential", "permission", "rbac", "role", "scope", "acl", "security", "sanitize", "validate", "csrf", "xss", "injection", "sql"]
STACK = ["FastAPI", "Django", "Flask", "Express", "Next.js", "React", "Vue", "PostgreSQL", "MySQL", "MongoDB", "Redis", "SQLite", "Celery", "RabbitMQ", "Kafka", "Docker", "Kubernetes", "SuperTokens", "Auth0", "JWT", "OAuth", "S3", "Cloudflare", "AWS", "GCP", "Azure", "SQLAlchemy", "Prisma", "TypeORM", "Drizzle", "Tailwind", "shadcn", "Material UI"]
PRIORITY_DOCS = ["CLAUDE.md", "AGENTS.md", "README.md", "ARCHITECTURE.md"]
COLUMN_WEIGHTS = {"content": 1.0, "summary": 2.0, "symbol_name": 3.0, "file_path": 1.5}
K1, B = 1.2, 0.75
BOOST_PRIORITY, BOOST_DOC, BOOST_INSIGHT, BOOST_PATH, RECENT, RECENT_HOURS = 3.0, 1.5, 2.0, 1.5, 0.15, 168

# Patterns of insights in conversations and their tags.
INSIGHT = (
    r"(?i)(decided|decision|chose|choosing|picked|went with|architecture|pattern|important|critical|note that|keep in mind|remember|caveat|gotcha|quirk"
    r"|the reason|because|tradeoff|trade-off|constraint|requirement|bug|issue|problem|fix|workaround|solution|resolved"
    r"|should always|should never|must|don't|avoid|prefer|instead of)"
)
TAGS = {
    "architecture": "architect|pattern|design|structure|layer", "auth": "auth|login|token|jwt|oauth|session", "database": "database|sql|query|migration|model|orm",
    "api": "endpoint|route|api|request|response", "performance": r"performance|optimi|cache|slow|fast|n\+1", "security": "security|vulnerab|inject|xss|csrf|sanitiz",
    "deployment": "deploy|docker|ci|cd|pipeline|release", "bug": "bug|fix|issue|error|crash|broken",
}
NOT_BASES = ["object", "ABC", "Exception", "BaseException"]
TEST_WORDS = ["test", "mock", "fixture", "conftest", "pytest"]

# Client calls with a literal address, as patterns with the number of the group of each part.
CLIENT_CALLS = [
    (r"""(?i)(?:fetch|axios|http|api)\s*[.(]\s*['"`]([^'"`]+)['"`]""", {"url": 1}),
    (r"""(?i)\.(get|post|put|patch|delete)\s*\(\s*['"`]([^'"`]+)['"`]""", {"verb": 1, "url": 2}),
    (r"""(?i)api\w*\.\w+\s*\(\s*['"`]([^'"`]+)['"`]""", {"url": 1}),
    (r"(?i)`[^`]*(?:/api/|/v1/)([^`]+)`", {"url": 1}),
]

# Addresses that are no calls, names of schemas, names that are no shared types.
NOT_CALLED = [".js", ".css", ".png", ".svg", "localhost"]
SCHEMA_ENDINGS = r":\s*([A-Z]\w+(?:Response|Request|Create|Update|Schema))"
REQUEST_WORDS, RESPONSE_WORDS = "request|body|payload", "response|return"
NOT_TYPES = ["BaseModel", "Base", "Meta", "Config"]

# How model fields and settings are written.
MAPPED_FIELD = r"^\s*([\p{L}\p{N}_]+):\s*Mapped\[([^\]]+)\]\s*=\s*mapped_column\(([\p{L}\p{N}_]+)?"
TYPED_FIELD = r"^\s+([\p{L}\p{N}_]+):\s*([\w\[\], |]+?)(?:\s*=|\s*$)"
NOT_FIELDS = r"^(_|model_)|^[A-Z_0-9]+$|^tablename$|^table_args$"
SETTING = r"(?m)^([A-Z][A-Z_0-9]+)\s*[:=]\s*(.+)$"
SETTINGS_CLASS = r"(?s)class\s+Settings\s*\([^\n]*\n(.*)"
SETTINGS_FIELD = r"^([\p{L}\p{N}_]+):\s*[\p{L}\p{N}_]+.*?=\s*(.+)$"
