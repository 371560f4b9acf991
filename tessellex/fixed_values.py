"""Word lists, patterns, weights and texts that results depend on.

They define the data semantics and must not change; the code that uses them is
elsewhere. Patterns are written flat, without flags, so that one text serves
Java's regex engine (Spark) and RE2 (the differential SQL); flags are added by
``functions.regexes``.
"""

# ---------------------------------------------------------------- tokens ----
WORD = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
# Characters that count as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Characters that end a line besides \r\n.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# ------------------------------------------------------------- retrieval ----
BM25_K1 = 1.5
BM25_B = 0.75
IDF_FLOOR = 1e-4
RRF_K = 60
OVERFETCH = 3
MMR_LAMBDA = 0.5
FUSION_ALPHA = 0.5
EMBED_BATCH = 50

# ------------------------------------------------------------- ingestion ----
PARSER_BY_EXTENSION = {
    ".pdf": "pdf",
    ".docx": "docx",
    ".doc": "docx",
    ".txt": "txt",
    ".text": "txt",
}
LINES_PER_PAGE = 60
PARAGRAPHS_PER_PAGE = 40
MIN_PAGE_CHARS = 30
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
HEADER_CHARS = 2000
DOC_TYPE_CHARS = 1000
PENALTY_WINDOW = 300
AUTHORITY_CONTEXT = 30
YEAR_MIN, YEAR_MAX = 1947, 2100
EXTRACTOR_VERSION = "1.0.0"
JURISDICTION = "India"

# -------------------------------------------------------------- patterns ----
_KINDS = r"(?:Act|Code|Order|Ordinance|Rules?|Regulations?)"
ACT_FULL = (
    r"(?:The\s+)?([A-Z][A-Za-z\s\(\),\-'&]+?" + _KINDS + r"(?:\s+\(Amendment\))?),?\s*(\d{4})"
)
ACT_SHORT = r"([A-Z][A-Za-z\s\-'&]+?" + _KINDS + r")\s*,?\s*(1[89]\d{2}|20\d{2})"
ACT_NUMBER = r"Act\s+No\.?\s*(\d+)\s+of\s+(\d{4})"
CHAPTER_ROMAN = r"CHAPTER\s+([IVXLCDM]+)(?:\s*[:\-–]\s*([A-Z][^\n]{3,80}))?"
CHAPTER_ARABIC = r"CHAPTER\s+(\d+)(?:\s*[:\-–]\s*([A-Z][^\n]{3,80}))?"
CHAPTER_LINE = r"(?:^|\n)\s*(CHAPTER\s+([IVXLCDM\d]+))"
CHAPTER_LINE_TITLE = r"^CHAPTER\s+[IVXLCDM\d]+(?:\s*[:\-–\s]\s*([^\n]+))?"
SECTION_TITLED = (
    r"^\s*(\d+[A-Z]?(?:\(\d+\))?(?:\([a-z]\))?)\.?\s+"
    r"([A-Z][A-Za-z\s,\(\)\-'&]{3,120})(?:\.\s*—|\s*\.—|\s*—|\.\-)"
)
SECTION_PLAIN = r"\bSection\s+(\d+[A-Z]?(?:\(\d+\))?)(?:\s+[Oo]f\s+)?"
SECTION_HEADER = (
    r"(?:^|\n)\s*(?:Section\s+)?(\d+[A-Z]?)\.\s*"
    r"([A-Z][^\n—\.-]{2,100})?(?:\.|\s*[\.—\-])"
)
SUB_SECTION = r"^\s*\(([1-9]\d?|[a-z]{1,2}|[ivx]+)\)\s+([A-Z].{0,200})"
NUMBERED_HEADING = r"^\s*\d+[A-Z]?\.\s+[A-Z]"
STRUCTURE_BOUNDARY = r"(?:^|\n)(?:CHAPTER\s+[IVXLCDM\d]+|\d+[A-Z]?\.\s+[A-Z]|Section\s+\d+)"
PAGE_FOOTER = r"(?:^|\f)\s*(?:Page\s+)?(\d+)\s*$"
PAGE_HEADER = r"^\s*\[?\s*(\d+)\s*\]?\s*$"
PROVISO = r"Provided\s+(?:further|also)?\s*that[^\.\n;]+[\.\n;]"
EXPLANATION = r"Explanation(?:\s+\d+)?[\.\s—\-]+[^\n]+(?:\n[^\n]+){0,5}"
ILLUSTRATION = (
    r"Illustration[s]?(?:\s*\([a-z]\)|\s+\d+)?[\.\s—\-]+[^\n]+(?:\n[^\n]+){0,5}"
)
EXCEPTION = r"Exception(?:\s+\d+)?[\.\s—\-]+[^\n]+(?:\n[^\n]+){0,5}"
SUB_SECTION_LINE = r"^\s*\((\d+|[a-z]|[ivx]+)\)\s+([^\n]+)"
_QUOTES = "[\u201c\u201d\"]"
_TERM = r"([A-Za-z][A-Za-z\s\-']{1,60}?)"
DEFINITION_MEANS = (
    r"(?:^|\n)\s*" + _QUOTES + r"?" + _TERM + _QUOTES + r"?\s*"
    r"(?:means|includes|shall\s+(?:mean|include)|refers?\s+to)\s+([^;\.]{10,500})[;.]"
)
DEFINITION_DASH = (
    r"(?:^|\n)\s*" + _QUOTES + _TERM + _QUOTES + r"\s*[—\-]\s*([^;\.]{10,500})[;.]"
)
DEFINITION_REF = (
    r"\(([a-z]{1,3}|\d+)\)\s+" + _QUOTES + r"?" + _TERM + _QUOTES
    + r"?\s+means\s+([^;\.]{10,300})[;.]"
)
PENALTY = (
    r"(?:punishable|liable|sentenced?)\s+(?:to|with)\s+"
    r"(?:(?:imprisonment[^,\.]{0,80})?(?:,?\s*(?:or|and)\s*)?(?:(?:a\s+)?fine[^,\.]{0,80})?)"
)
PENALTY_TERM = r"(\d+(?:\.\d+)?)\s*year[s]?|(\d+)\s*month[s]?"
PENALTY_FINE = (
    r"(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d+)?)"
    r"|((?:one|two|three|five|ten|twenty|fifty|hundred|thousand|lakh|crore)"
    r"(?:\s+(?:thousand|lakh|crore|hundred))*)\s+rupees?"
)
RELATED_SECTION = r"\bsection\s+(\d+[A-Z]?(?:\s*\(\d+\))?)(?:\s+of\s+this\s+Act)?"
CROSS_REFERENCE = (
    r"\b(?:section|rule|article|schedule|clause)\s+(\d+[A-Z]?(?:\s*\(\d+\))?)\s+of\s+(?:the\s+)?"
    r"([A-Z][A-Za-z\s\(\),\-'&]+?" + _KINDS + r")(?:,?\s*(\d{4}))?"
)
SCHEDULE_REFERENCE = (
    r"\b(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Eleventh|Twelfth)"
    r"\s+Schedule\b"
)
ANSWER_SECTION = r"\b(?:section|sec\.|rule)\s+\d+[a-z]?(?:\(\d+\))?"

# Authority type, pattern; list order is output order.
AUTHORITIES = (
    ("central_government", r"Central\s+Government"),
    ("state_government", r"State\s+Government"),
    ("registrar_general", r"Registrar[- ]General"),
    ("passport_authority", r"Passport\s+(?:Authority|Officer|Office)"),
    ("immigration_officer", r"Immigration\s+Officer"),
    (
        "foreigners_regional_registration_officer",
        r"(?:FRRO|Foreigners['\s]+Regional['\s]+Registration['\s]+Officer)",
    ),
    ("tribunal", r"Foreigners\s+Tribunal"),
    ("court", r"(?:High\s+Court|Supreme\s+Court|District\s+Court|Sessions\s+Court)"),
)

# Keyword vocabulary by group.
KEYWORD_GROUPS = {
    "citizenship": (
        "citizenship", "citizen", "naturalisation", "naturalization", "domicile", "stateless",
        "renunciation", "deprivation", "registration of citizens", "citizenship certificate",
    ),
    "immigration": (
        "immigration", "immigrant", "port of entry", "border control", "immigration officer",
        "entry permit", "arrival card", "immigration clearance",
    ),
    "emigration": (
        "emigration", "emigrant", "emigration clearance", "ecr", "emigration check required",
        "protected area", "foreign employment",
    ),
    "passport": (
        "passport", "travel document", "diplomatic passport", "official passport",
        "emergency certificate", "passport authority", "passport officer", "passport application",
    ),
    "visa": (
        "visa", "tourist visa", "student visa", "work visa", "visa on arrival", "e-visa",
        "visa extension", "multiple entry", "single entry",
    ),
    "foreigners": (
        "foreigner", "foreign national", "alien", "frro", "foreigners registration",
        "residential permit", "prohibited area", "restricted area", "deportation", "expulsion",
        "internment",
    ),
    "penalty": (
        "penalty", "offence", "fine", "imprisonment", "punishable", "conviction", "sentence",
        "prosecution",
    ),
    "authority": (
        "central government", "state government", "registrar general", "passport authority",
        "immigration officer", "foreigners tribunal",
    ),
}

# Domain, substrings counted for it; first declared domain wins a tie.
DOMAIN_SIGNALS = (
    ("citizenship", ("citizenship", "citizen", "naturalisation")),
    ("immigration", ("immigration", "immigrant", "port of entry")),
    ("emigration", ("emigration", "emigrant", "ecr", "emigration clearance")),
    ("passport", ("passport", "travel document", "passport authority")),
    ("visa", ("visa", "tourist visa", "work visa", "e-visa")),
    ("foreigners", ("foreigner", "foreign national", "frro", "alien")),
)
DOMAINS = tuple(name for name, _ in DOMAIN_SIGNALS) + ("unknown",)

# Document type, substrings that decide it; first match wins.
DOCUMENT_TYPE_SIGNALS = (
    ("amendment", ("amendment",)),
    ("rule", ("rules", "regulation")),
    ("notification", ("notification", "circular")),
    ("act", ("act",)),
)

CONFIDENCE_WEIGHTS = {
    "act_name": 0.20,
    "chapter_number": 0.10,
    "section_number": 0.15,
    "section_title": 0.10,
    "keywords": 0.10,
    "definitions": 0.10,
    "authorities": 0.10,
    "penalty": 0.05,
    "related_sections": 0.05,
    "cross_references": 0.05,
}

# ---------------------------------------------------------- page locator ----
LOCATOR_STOP_WORDS = (
    "this", "that", "with", "from", "under", "have", "such", "shall", "section", "rules", "act",
    "other", "said", "penalty", "refusal",
)
HEADING_STOP_WORDS = (
    "this", "that", "with", "from", "under", "have", "such", "shall", "section", "rules", "act",
)
CONTENTS_PHRASES = (
    "ARRANGEMENT OF SECTIONS",
    "ARRANGEMENT OF CLAUSES",
    "TABLE OF CONTENTS",
    "LIST OF ABBREVIATIONS",
)
CONTENTS_LINE = r"(?:\n|^)\s*\d+\.\s+[A-Za-z]"
BODY_SUB_SECTION = r"\(\d+\)\s+[A-Z]|\([a-z]\)\s+[A-Z]"
FORM_HEADER = r"(?:\n|^)\s*(?:FORM|SCHEDULE|APPENDIX)\s+[I|V|X|\d+]"
NO_SECTION = ("N/A", "GENERAL", "NONE", "")
LOCATOR_SCORES = {
    "heading": 60, "section_word": 20, "title_word": 10, "not_contents": 30, "not_form": 20,
}
DEVANAGARI = "[^\u0900-\u097f]"
DEVANAGARI_MIN, DEVANAGARI_RATIO = 80, 0.15

# Act-name key, file; first key contained in the act name wins.
ACT_FILES = (
    ("citizenship act", "the_citizenship_act_1955.pdf"),
    ("citizenship act, 1955", "the_citizenship_act_1955.pdf"),
    ("citizenship", "the_citizenship_act_1955.pdf"),
    ("passports act", "passports_act_1967.pdf"),
    ("passports act, 1967", "passports_act_1967.pdf"),
    ("passport act", "passports_act_1967.pdf"),
    ("passport", "passports_act_1967.pdf"),
    ("emigration act", "THE EMIGRATION ACT, 1983.pdf"),
    ("emigration act, 1983", "THE EMIGRATION ACT, 1983.pdf"),
    ("emigration", "THE EMIGRATION ACT, 1983.pdf"),
    ("foreigners act", "The Immigration and Foreigners Act, 2025.pdf"),
    ("immigration and foreigners act", "The Immigration and Foreigners Act, 2025.pdf"),
    ("foreigners act, 1946", "The Immigration and Foreigners Act, 2025.pdf"),
    ("foreigners rules", "Immigration and Foreigners Rules 2025.pdf"),
    ("citizenship 2015", "The_Citizenship_(Amendment)_Act,_2015_20012026.pdf"),
    ("citizenship 2019", "The_Citizenship_(Amendment)_Act,_2019_20012026.pdf"),
)
RULES_FILE = "Immigration and Foreigners Rules 2025.pdf"
DEFAULT_FILE = "the_citizenship_act_1955.pdf"

# ------------------------------------------------------------ answer texts ----
MARK_OPEN = (
    '<mark style="background-color: rgba(59, 130, 246, 0.3); color: #93C5FD; '
    'padding: 0 3px; border-radius: 3px; font-weight: 600;">'
)
MARK_CLOSE = "</mark>"
NO_CONTEXT = "No relevant statutory passages found in the database."
NO_DOCUMENTS_ANSWER = (
    "I couldn't find any relevant statutory provisions in the indexed legal documents "
    "for this query. Consider broadening the search or uploading additional statutory material."
)
FAILED_TITLE = "Document Retrieval Temporarily Unavailable"
FAILED_MESSAGE = (
    "Our legal knowledge base could not be searched because the retrieval service is "
    "currently unavailable or has exceeded its usage limit. Please try again later."
)
FAILED_ANSWER = (
    "### ⚠️ Document Retrieval Temporarily Unavailable\n\n"
    "Our legal knowledge base could not be searched because the retrieval service is "
    "currently unavailable or has exceeded its usage limit.\n\n"
    "Please try again later. If the issue persists, contact the administrator."
)
PENALTY_WORDS = (
    "offence", "offense", "penalty", "punishable", "imprisonment", "fine", "conviction",
    "prosecution",
)
REFUSAL = r"do(es)? not contain sufficient information"
CONVERSATION_TITLE_CHARS = 45

# -------------------------------------------------------------- evaluation ----
PASS_GROUNDEDNESS = 0.8
# Label, result column, comparison, threshold, status when missed.
REPORT_TARGETS = (
    ("Retrieval Recall", "mean_recall", ">=", 0.80, "FAIL"),
    ("Retrieval Precision", "mean_precision", ">=", 0.75, "FAIL"),
    ("Faithfulness", "mean_faithfulness", ">=", 0.85, "FAIL"),
    ("Groundedness", "mean_groundedness", ">=", 0.85, "FAIL"),
    ("Hallucination Rate", "mean_hallucination_rate", "<=", 0.15, "FAIL"),
    ("Citation Accuracy", "mean_citation_accuracy", ">=", 0.90, "FAIL"),
    ("Mean Latency", "mean_latency_seconds", "<=", 3.0, "WARN"),
)
