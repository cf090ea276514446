"""Registries and word lists whose entries the results depend on."""

# --- fixed values: file type, language and parser by extension ----------------------------------------------
EXTENSIONS = {
    ".py": ("code", "python", "python"),
    ".pyw": ("code", "python", "python"),
    ".js": ("code", "javascript", "treesitter"),
    ".jsx": ("code", "javascript", "treesitter"),
    ".mjs": ("code", "javascript", "treesitter"),
    ".ts": ("code", "typescript", "treesitter"),
    ".tsx": ("code", "typescript", "treesitter"),
    ".java": ("code", "java", "treesitter"),
    ".c": ("code", "c", "treesitter"),
    ".h": ("code", "c", "treesitter"),
    ".cpp": ("code", "cpp", "treesitter"),
    ".cc": ("code", "cpp", "treesitter"),
    ".hpp": ("code", "cpp", "treesitter"),
    ".go": ("code", "go", "treesitter"),
    ".rs": ("code", "rust", "treesitter"),
    ".html": ("code", "html", "html"),
    ".htm": ("code", "html", "html"),
    ".css": ("code", "css", "css"),
    ".scss": ("code", "scss", "css"),
    ".sass": ("code", "scss", "css"),
    ".less": ("code", "less", "css"),
    ".sh": ("script", "shell", "shell"),
    ".bash": ("script", "shell", "shell"),
    ".zsh": ("script", "shell", "shell"),
    ".fish": ("script", "shell", "shell"),
    ".sql": ("code", "sql", "sql"),
    ".json": ("data", "json", "json"),
    ".yaml": ("config", "yaml", "yaml"),
    ".yml": ("config", "yaml", "yaml"),
    ".toml": ("config", "toml", "toml"),
    ".xml": ("data", "xml", "xml"),
    ".svg": ("data", "xml", "xml"),
    ".csv": ("data", "csv", "csv"),
    ".tsv": ("data", "csv", "csv"),
    ".md": ("doc", "markdown", "markdown"),
    ".mdx": ("doc", "markdown", "markdown"),
    ".rmd": ("doc", "markdown", "markdown"),
    ".rst": ("doc", "rst", "rst"),
    ".txt": ("doc", "text", "text"),
    ".pdf": ("doc", "pdf", "pdf"),
    ".ipynb": ("notebook", "jupyter", "notebook"),
    ".dockerfile": ("infra", "dockerfile", "dockerfile"),
    ".tf": ("infra", "terraform", "generic_code"),
    ".hcl": ("infra", "hcl", "generic_code"),
    ".rb": ("code", "ruby", "generic_code"),
    ".php": ("code", "php", "generic_code"),
    ".swift": ("code", "swift", "generic_code"),
    ".kt": ("code", "kotlin", "generic_code"),
    ".kts": ("code", "kotlin", "generic_code"),
    ".r": ("code", "r", "generic_code"),
    ".graphql": ("code", "graphql", "generic_code"),
    ".gql": ("code", "graphql", "generic_code"),
    ".proto": ("code", "protobuf", "generic_code"),
    ".dart": ("code", "dart", "generic_code"),
    ".lua": ("code", "lua", "generic_code"),
    ".scala": ("code", "scala", "generic_code"),
    ".ex": ("code", "elixir", "generic_code"),
    ".exs": ("code", "elixir", "generic_code"),
    ".cs": ("code", "csharp", "generic_code"),
    ".fs": ("code", "fsharp", "generic_code"),
    ".vue": ("code", "vue", "html"),
    ".svelte": ("code", "svelte", "html"),
}
# --- fixed values: the same by file name, without a known extension -------------------------------------------
FILE_NAMES = {
    "dockerfile": ("infra", "dockerfile", "dockerfile"),
    "makefile": ("infra", "makefile", "makefile"),
    "gnumakefile": ("infra", "makefile", "makefile"),
    "justfile": ("infra", "makefile", "makefile"),
    "requirements.txt": ("config", "text", "text"),
    "gemfile": ("config", "text", "text"),
    "procfile": ("config", "text", "text"),
    "pipfile": ("config", "toml", "toml"),
    "rakefile": ("code", "ruby", "generic_code"),
    "cmakelists.txt": ("infra", "text", "text"),
}

# --- fixed values: what is never read ----------------------------------------------------------------------
SKIPPED_EXTENSIONS = (
    ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .psd .mp4 .mp3 .mov .avi .wav .ogg .flac .zip .tar .gz .rar .7z .bz2 .xz .exe .dll .so .dylib"
    " .bin .class .pyc .pyo .wasm .map .lock .sum .ttf .woff .woff2 .eot .otf .db .sqlite .pickle .pkl .npy .npz .env .ini .cfg .conf"
).split()
SKIPPED_NAMES = (
    ".env .env.local .env.example .env.production .env.staging .gitignore .gitattributes .dockerignore .editorconfig .prettierrc .eslintrc .eslintignore .babelrc .npmrc .yarnrc"
).split()
SKIPPED_FOLDERS = (
    ".git __pycache__ node_modules .venv venv env dist build .next .nuxt .idea .vscode migrations coverage .pytest_cache .mypy_cache vendor third_party extern deps bower_components .tox eggs .eggs htmlcov"
).split()
SKIPPED_PATTERN = (
    r"(?i)^(?:.*\.min\.(?:js|css)|.*-lock\.(?:json|yaml)|package-lock\.json|yarn\.lock|poetry\.lock|pipfile\.lock|composer\.lock|cargo\.lock|.*\.bundle\.js|.*\.chunk\.js)$"
)

# --- fixed values: names of languages ----------------------------------------------------------------------
LANGUAGE_NAMES = {
    "py": "python",
    "pyw": "python",
    "js": "javascript",
    "mjs": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "fish": "shell",
    "md": "markdown",
    "mdx": "markdown",
    "rmd": "markdown",
    "yml": "yaml",
    "rs": "rust",
    "rb": "ruby",
    "kt": "kotlin",
    "kts": "kotlin",
    "ex": "elixir",
    "exs": "elixir",
    "tf": "terraform",
    "hcl": "terraform",
    "ipynb": "jupyter",
}

# --- fixed values: comment forms of each language, in the order in which they are removed -----------------------
_SLASHES = (r"/\*[\s\S]*?\*/", r"//[^\n]*")
COMMENTS = {
    "python": (r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", r"#[^\n]*"),
    **dict.fromkeys(("javascript", "typescript", "java", "c", "cpp", "go", "rust", "scss", "kotlin", "swift"), _SLASHES),
    "css": _SLASHES[:1],
    "shell": (r"#[^\n]*",),
    "sql": (r"--[^\n]*", r"/\*[\s\S]*?\*/"),
    "ruby": (r"#[^\n]*", r"=begin[\s\S]*?=end"),
    "php": (*_SLASHES, r"#[^\n]*"),
    "r": (r"#[^\n]*",),
}

# --- fixed values: keywords of the topic tags ----------------------------------------------------------------
TAGS = {
    "auth": ["login", "logout", "authenticate", "authorize", "jwt", "oauth", "token", "session", "password", "credential", "permission", "role", "rbac", "bearer"],
    "async": ["async", "await", "promise", "future", "coroutine", "asyncio", "aiohttp", "concurrent", "thread", "executor"],
    "crud": ["create", "read", "update", "delete", "insert", "select", "upsert", "findone", "findall", "save", "remove"],
    "error_handling": ["try", "except", "catch", "finally", "raise", "throw", "error", "exception", "traceback", "fallback", "retry"],
    "logging": ["logger", "logging", "log.info", "log.debug", "log.error", "log.warning", "print(", "console.log", "sentry"],
    "caching": ["cache", "redis", "memcached", "lru_cache", "ttl", "invalidate", "evict", "cached_property"],
    "config": ["config", "settings", "env", "environ", "dotenv", "configparser", "argparse", ".env"],
    "database": ["database", "db", "sql", "orm", "sqlalchemy", "django.db", "mongoose", "prisma", "sequelize", "cursor", "transaction"],
    "networking": ["http", "https", "request", "response", "socket", "tcp", "udp", "grpc", "websocket", "fetch", "axios", "httpx"],
    "filesystem": ["open(", "read(", "write(", "pathlib", "os.path", "shutil", "glob", "makedirs", "walk("],
    "testing": ["test_", "def test", "assert", "unittest", "pytest", "mock", "fixture", "describe(", "it(", "expect("],
    "security": ["encrypt", "decrypt", "hash", "salt", "hmac", "aes", "rsa", "ssl", "tls", "sanitize", "csrf", "xss"],
    "serialization": ["json", "pickle", "marshal", "serialize", "deserialize", "encode", "decode", "yaml.dump", "yaml.load"],
    "validation": ["validate", "validator", "pydantic", "schema", "required", "isinstance", "assert", "constraint", "regex"],
    "concurrency": ["thread", "mutex", "lock", "semaphore", "queue", "multiprocessing", "parallel", "race", "deadlock"],
    "ml": ["model", "train", "predict", "tensor", "numpy", "pandas", "sklearn", "torch", "tensorflow", "keras", "embedding", "loss", "optimizer", "epoch", "batch_size"],
    "ui": ["render", "component", "props", "state", "usestate", "useeffect", "template", "html", "css", "dom", "react", "vue", "svelte", "angular"],
    "routing": ["route", "router", "endpoint", "url", "path", "get(", "post(", "put(", "delete(", "app.get", "app.post"],
    "middleware": ["middleware", "interceptor", "hook", "filter", "decorator", "before_request", "after_request"],
    "deployment": ["dockerfile", "docker", "k8s", "kubernetes", "helm", "deploy", "release", "ci", "cd", "github actions"],
    "documentation": ["docstring", "readme", "changelog", "comment", "sphinx", "jsdoc", "mkdocs", "openapi", "swagger"],
    "migration": ["migration", "migrate", "alembic", "flyway", "schema", "alter table", "add column", "drop column"],
    "parsing": ["parse", "parser", "ast", "tokenize", "lex", "grammar", "regex", "xpath", "beautifulsoup", "lxml"],
    "streaming": ["stream", "generator", "yield", "iterable", "pipe", "kafka", "rabbitmq", "pubsub", "event"],
    "utils": ["util", "helper", "common", "shared", "misc", "tools", "format", "convert"],
}

# --- fixed values: forms of the flags and of public definitions ----------------------------------------------
DOC_FORM = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''|/\*[\s\S]*?\*/"
TODO_FORM = r"(?i)\b(?:TODO|FIXME|HACK|XXX)\b"
TEST_FORM = r"(?i)\b(?:def test_|it\(|describe\(|test\(|@pytest|unittest\.)"
PUBLIC_FORM = r"(?:^|\n)\s*(?:export\s+)?(?:async\s+)?(?:def|function|class|func|fn)\s+([A-Za-z][A-Za-z0-9_]*)"
BRANCH_FORM = r"(?i)\b(?:if|elif|else|for|while|try|except|catch|switch|case|match|with)\b"

# --- fixed values: entity rules in their order; of several groups the first that matched is the entity -------------
ENTITY_RULES = [
    ("FUNC", r"\bdef\s+([A-Za-z_][A-Za-z0-9_]*)|([A-Za-z_][A-Za-z0-9_]*)\s*(?:=\s*)?(?:async\s+)?function\b|\b([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\(", 3),
    ("CLASS", r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)", 1),
    ("LIB", r"(?:import|from|require|use)\s+[\"']?([A-Za-z_][A-Za-z0-9_./\-]*)[\"']?", 1),
    ("URL", r"https?://[^\s'\"<>]+", 0),
    ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0),
    ("TODO", r"\b(TODO|FIXME|HACK|NOQA|NOTE|XXX)\b[:\s][^\n]*", 1),
    ("FILE_PATH", r"(?:/[A-Za-z0-9_.\-]+){2,}|[A-Za-z]:\\[A-Za-z0-9_\\.\-]+", 0),
    ("DECORATOR", r"@([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)", 1),
    ("SQL_TABLE", r"(?i)(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+([A-Za-z_][A-Za-z0-9_]*)", 1),
    ("ENV_VAR", r"\$\{?([A-Z_][A-Z0-9_]{2,})\}?|os\.environ\[[\"']([A-Z_][A-Z0-9_]+)[\"']\]", 2),
    ("VERSION", r"\bv?([0-9]+\.[0-9]+(?:\.[0-9]+)?(?:[-+][A-Za-z0-9_]+)?)\b", 1),
    ("CSS_SELECTOR", r"(?:^|[\n;])\s*([.#]?[A-Za-z][A-Za-z0-9_\-]*(?:\s*[>+~]\s*[.#]?[A-Za-z][A-Za-z0-9_\-]*)*)\s*\{", 1),
    ("GQL_TYPE", r"\b(?:type|interface|enum|input)\s+([A-Z][A-Za-z_]*)\b", 1),
]

# --- fixed values: kinds of chunks by how they are segmented -------------------------------------------------
DOC_CHUNKS = "doc_section doc_paragraph markdown rst html_text html_section notebook_markdown_cell".split()
CODE_CHUNKS = "function method class code_block shell_function script_block notebook_code_cell sql_select sql_create".split()
DATA_CHUNKS = "json_key json_array_batch yaml_section toml_section csv_batch xml_element".split()
HEADING_FORM = r"(?m)^#{1,6}\s+[^\n]+$"
FUNCTION_FORM = r"^(?:async\s+)?(?:def|function|func|fn|public|private|protected|static|void|int|str|bool|float)\s+\w+"
CLASS_FORM = r"^(?:class|struct|interface|impl|trait)\s+\w+"

# --- fixed values: scripts that tell a language, with the share of their letters counting five times up to 0.95 ------------
SCRIPTS = {
    "hi": r"[\x{0900}-\x{097F}]",
    "ar": r"[\x{0600}-\x{06FF}]",
    "zh": r"[\x{4E00}-\x{9FFF}]",
    "ja": r"[\x{3040}-\x{30FF}]",
    "ko": r"[\x{AC00}-\x{D7AF}]",
    "ru": r"[\x{0400}-\x{04FF}]",
    "el": r"[\x{0370}-\x{03FF}]",
    "he": r"[\x{0590}-\x{05FF}]",
    "th": r"[\x{0E00}-\x{0E7F}]",
}
# --- fixed values: the same for queries, which more scripts tell ------------------------------------------------
QUERY_SCRIPTS = {
    **SCRIPTS,
    "ta": r"[\x{0B80}-\x{0BFF}]",
    "te": r"[\x{0C00}-\x{0C7F}]",
    "kn": r"[\x{0C80}-\x{0CFF}]",
    "ml": r"[\x{0D00}-\x{0D7F}]",
    "bn": r"[\x{0980}-\x{09FF}]",
    "gu": r"[\x{0A80}-\x{0AFF}]",
    "pa": r"[\x{0A00}-\x{0A7F}]",
}
# --- fixed values: names of the languages of queries --------------------------------------------------------------
QUERY_LANGUAGES = {
    "en": "English", "ta": "Tamil", "hi": "Hindi", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam", "mr": "Marathi", "bn": "Bengali", "gu": "Gujarati",
    "pa": "Punjabi", "ur": "Urdu", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "ru": "Russian", "zh": "Chinese",
    "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "he": "Hebrew", "th": "Thai", "vi": "Vietnamese", "id": "Indonesian", "ms": "Malay", "tr": "Turkish",
    "pl": "Polish", "nl": "Dutch", "sv": "Swedish", "fi": "Finnish", "el": "Greek", "uk": "Ukrainian", "cs": "Czech", "ro": "Romanian", "hu": "Hungarian",
}
# --- fixed values: entity rules of queries in their order; of a group the entity, else the whole match -------------
QUERY_ENTITY_RULES = [
    ("FUNC", r"\bdef\s+([A-Za-z_][\p{L}\p{N}_]*)", 1),
    ("CLASS", r"\bclass\s+([A-Za-z_][\p{L}\p{N}_]*)", 1),
    ("LIB", r"(?:import|from|require|use)\s+[\"']?([A-Za-z_][\p{L}\p{N}_./\-]*)[\"']?", 1),
    ("URL", r"https?://[^\s'\"<>]+", 0),
    ("TODO", r"(?i)\b(TODO|FIXME|HACK|XXX)\b", 1),
    ("FILE_PATH", r"(?:/[\p{L}\p{N}_.\-]+){2,}", 0),
    ("ENV_VAR", r"\$\{?([A-Z_][A-Z0-9_]{2,})\}?", 1),
    ("VERSION", r"\bv?([0-9]+\.[0-9]+(?:\.[0-9]+)?)\b", 1),
]
# --- fixed values: colours of complexity scores below each bound, and of all others ---------------------------------
COMPLEXITY_COLOURS = [(0.25, "#34d399"), (0.5, "#60a5fa"), (0.75, "#fbbf24"), (None, "#f472b6")]
# --- fixed values: folders that a report leaves out wherever their name stands in a path, and the endings it takes ----
REPORT_SKIPPED = ["venv", "chroma", "__pycache__", ".git", "node_modules"]
REPORT_ENDINGS = [".py", ".js", ".java", ".cpp"]
REPORT_CHARS = 4000
