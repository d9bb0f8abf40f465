"""Constants, word lists and patterns that results depend on."""

# --- fixed values: limits -------------------------------------------------------------------------
MAX_TOKENS = 512
MIN_TOKENS = 40
UNTITLED = "UNTITLED"
MIN_PAGE_CHARS = 50
MIN_CONFIDENCE = 65.0
MIN_ALNUM_RATIO = 0.5
MIN_ALPHA_RUN = 5
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
CENTROID_THRESHOLD = 0.5
LOW_CONFIDENCE_CEILING = 0.60
TOP_K = 5
POOL = 20
RRF_K = 60
PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
DAILY_UPLOADS = 10
OTP_MAX_SENDS, OTP_WINDOW_S, OTP_COOLDOWN_S, OTP_ATTEMPTS, OTP_EXPIRY_S = 5, 900, 60, 5, 600
PACE_WINDOW_S, PACE_TOKENS, PACE_FLOOR_S, LLM_FLOOR_S = 60, 10_000, 21, 3
LONG_RETRY_S = 90
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
MIN_SPAN_CHARS = 40
HEADING_LOOKBACK, LONG_LINE = 200, 80

# --- fixed values: categories, in alphabetical (tie) order, with thresholds and phrases --------------
CATEGORIES = ("Confidentiality", "Governing Law / Jurisdiction", "Indemnification", "Limitation of Liability", "Termination")
THRESHOLDS = {
    "Limitation of Liability": 0.62,
    "Indemnification": 0.71,
    "Termination": 0.65,
    "Governing Law / Jurisdiction": 0.55,
    "Confidentiality": 0.68,
}
LEXICON = {
    "Limitation of Liability": (
        "limitation of liability", "limitations of liability", "limitation on liability", "limitations on liability", "liability limitation",
        "liability cap", "cap on liability", "exclusion of damages", "damages exclusion", "exclusion of consequential damages",
        "consequential damages", "limitation of damages", "limitation of remedies", "special or punitive damages", "punitive damages",
        "aggregate liability",
    ),
    "Indemnification": ("indemnification", "indemnity", "indemnities", "hold harmless"),
    "Termination": ("termination", "terminate", "cancellation", "cancel"),
    "Governing Law / Jurisdiction": (
        "governing law", "choice of law", "conflict of laws", "conflicts of law", "applicable law", "jurisdiction", "venue", "forum selection",
    ),
    "Confidentiality": (
        "confidentiality", "confidential information", "confidential materials", "non-disclosure", "nondisclosure", "non disclosure",
        "proprietary information", "proprietary materials", "trade secret",
    ),
}

# --- fixed values: enumerations --------------------------------------------------------------------
SEVERITIES = ("low", "medium", "high")
SEVERITY_ORDER = {"high": 0, "medium": 1, "needs_manual_review": 2, "flagging_failed": 3, "low": 4}
AUDIT_EVENTS = (
    "validation_failure", "validation_retry_success", "validation_needs_manual_review", "api_error_retry", "api_error_failed",
    "grounding_failure", "grounding_error", "final_flag_decision",
)
NOT_FOUND_TOLERANCE = 3
STAGES = ("extracting", "chunking", "persisting", "embedding", "flagging", "complete")

# --- fixed values: patterns, usable in Java and RE2 --------------------------------------------------
NUMBER_3 = r"^\d+\.\d+\.\d+\b"
NUMBER_2 = r"^\d+\.\d+\b"
NUMBER_1 = r"^\d+\.\s"
SECTION = r"^(?i:Section)\s+(\d+(?:\.\d+)*)\b"
ARTICLE = r"^(?i:Article\s+(?:[IVXLCDM]+|\d+))\b"
PAREN_ROMAN = r"^\((?i:i|ii|iii|iv|v|vi|vii|viii|ix|x)\)"
PAREN_LETTER = r"^\([a-zA-Z]\)"
PAREN_NUMBER = r"^\(\d+\)"
CAPITALS = r"^[A-Z][A-Z0-9 ,&/\-]{2,59}$"
SENTENCE_END = r"""[.!?]['")\]]*$"""
LEADING_NUMBER = (
    r"^(?i:(?:article|section|clause|item)\s+[ivxlcdm\d]+(?:\.\d+)*\s*[.:)\-–—]*"
    r"|\([a-z0-9]+\)"
    r"|[ivxlcdm\d]+(?:\.\d+)*[.:)\-–—\s]+)\s*"
)
HEADING_TRIM = " .:;,-–—()[]<>"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"
TIMING = r"TIMING (\{.*\})\s*$"
