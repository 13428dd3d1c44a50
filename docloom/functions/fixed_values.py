"""Word lists, patterns, limits, prices and bounds.

These must stay exactly as they are for results to agree with existing data.
Patterns are written in the syntax shared by Java and RE2.
"""

# --- characters -------------------------------------------------------------
# Unicode white space as Python's str.strip / str.split see it.
SPACE_RANGES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    chr(c)
    for lo, hi in [
        (0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ]
    for c in range(lo, hi + 1)
)
# Letters, numbers, underscore (Python's \w), white space, all ASCII
# punctuation and the two extended ranges of the quality gate.
VALID_CHARS = r"\p{L}\p{N}" + SPACE_RANGES + r"!-~\x{c0}-\x{1ef9}\x{2010}-\x{2026}"

# --- upload limits ----------------------------------------------------------
MAX_FILE_BYTES = 100 * 1024 * 1024
QUOTA_BYTES = 100 * 1024 * 1024 * 1024
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".txt", ".md"]
MAGIC_PDF = "25504446"
MAGIC_WORD = ["504B0304", "D0CF11E0", "504B0506"]
UPLOADS_PER_MINUTE_USER = 10
UPLOADS_PER_MINUTE_PROJECT = 100

# --- chat limits ------------------------------------------------------------
MAX_MESSAGE_CHARS = 12000
HISTORY_MESSAGES = 30
HISTORY_CHARS = 50000
CHAT_CONCURRENT = 3
CHAT_PER_MINUTE = 20
CHAT_PER_DAY = 500
RUN_LEASE_SECONDS = 120

# --- semantic cache and memory ----------------------------------------------
CACHE_MIN_SCORE = 0.92
CACHE_TTL_SECONDS = 604800
MEMORY_MIN_SCORE = 0.4

# --- scope checks -----------------------------------------------------------
INJECTION_PATTERNS = [
    r"ignore\s+(?:any|previous|the)\s+instructions",
    r"system\s+prompt\s*(?:disclosure|leak|show|print)",
    r"override\s+(?:developer|system|filter)",
    r"jailbreak",
    r"forget\s+(?:your\s+)?(?:rules|instructions)",
    r"you\s+are\s+now\s+a\s+helpful\s+assistant\s+without\s+restrictions",
]
GREETINGS = ["hello", "hi", "hey", "thank you", "thanks", "bye", "goodbye", "chào", "cảm ơn"]

# --- vendors and advisories -------------------------------------------------
VENDORS = [
    "microsoft", "apple", "google", "linux", "cisco", "oracle",
    "apache", "nginx", "adobe", "ibm", "intel", "amd",
]
ADVISORY_DOMAINS = [
    "microsoft.com", "apple.com", "google.com", "cisco.com", "oracle.com", "redhat.com",
    "ubuntu.com", "debian.org", "apache.org", "nginx.org", "adobe.com", "ibm.com",
    "intel.com", "amd.com", "nvd.nist.gov", "cve.org",
]

# --- redaction and masking --------------------------------------------------
DB_URL_PATTERN = (
    r"((?:postgresql|postgres|mysql|sqlite|redis|amqp|mongodb)(?:\+[^:]+)?://[^:]+:)([^@]+)(@)"
)
SECRET_PATTERNS = [
    (r"sk-[a-zA-Z0-9\-]{20,}", "sk-proj-...[REDACTED]"),
    (r"pk-lf-[a-zA-Z0-9\-]{20,}", "pk-lf-...[REDACTED]"),
    (r"sk-lf-[a-zA-Z0-9\-]{20,}", "sk-lf-...[REDACTED]"),
    (r"bearer\s+[a-zA-Z0-9\-\._~\+\/]+=*", "Bearer ...[REDACTED]"),
]
SENSITIVE_KEYS = ["password", "secret", "token", "api_key", "private_key", "authorization"]

# --- document profiles ------------------------------------------------------
SLIDE_KEYWORDS = [
    "slide", "slides", "presentation", "deck", "infographic", "overview", "diagram",
    "flowchart", "mindmap", "cheatsheet", "pitch", "keynote", "architecture", "roadmap",
]
PAGE_MARKER = r"(?i)<!--\s*page:\s*([0-9]+)(?:-[0-9]+)?\s*-->|##\s*Trang\s*([0-9]+)|##\s*Page\s*([0-9]+)"
STEPS = ["virus_scan", "parse", "summary", "chunk", "dedup", "enrich", "embed", "link", "finalize"]
MAX_FAILED_RATIO = 0.05

# --- prices in USD per token ------------------------------------------------
EMBEDDING_PRICES = {
    "text-embedding-3-small": 0.020 / 1_000_000,
    "text-embedding-3-large": 0.130 / 1_000_000,
    "text-embedding-ada-002": 0.100 / 1_000_000,
}
EMBEDDING_DEFAULT_PRICE = 0.020 / 1_000_000
CHAT_PRICES = {
    "gpt-4o-mini": (0.150 / 1_000_000, 0.600 / 1_000_000),
    "gpt-4o": (2.500 / 1_000_000, 10.000 / 1_000_000),
    "gpt-4-turbo": (10.000 / 1_000_000, 30.000 / 1_000_000),
}
CHAT_DEFAULT_PRICE = (0.150 / 1_000_000, 0.600 / 1_000_000)

# --- histogram bounds -------------------------------------------------------
STEP_SECONDS_BOUNDS = [0.1, 0.5, 1, 5, 10, 30, 60, 300]
FILE_SIZE_BOUNDS = [1e6, 10e6, 50e6, 100e6]
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0, 40.0, 60.0]
DOCUMENT_SIZE_BOUNDS = [1e4, 1e5, 1e6, 10e6, 100e6]
EMBED_BATCH_BOUNDS = [1, 5, 10, 20, 50, 100]
QUALITY_BOUNDS = [0.0, 0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
CHUNKS_BOUNDS = [5, 20, 50, 100, 250, 500, 1000, 5000]

# --- texts of a turn's brief --------------------------------------------------
NO_TURNS = "No previous turns executed yet. This is Turn 1."
FILES_HEAD = "Files currently in workspace (STATE_DIR): "
FILES_HINT = "To access the contents of these files, write Python code to load them (using pathlib and json)."
NEXT_STEP = (
    "Based on this history, write the next Python code block to execute.\n"
    "Remember to wrap your Python code in a ```python ... ``` block, "
    "and serialize any new outputs/data into STATE_DIR."
)
