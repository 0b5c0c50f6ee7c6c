"""Fixed values.

Everything in this file is a value that results depend on and that has to be
exactly this: word lists, lookup tables, thresholds, patterns and formats.
They are plain data; the logic that uses them is elsewhere. Patterns are
written in the subset that Java and RE2 both read; flags are added by the
caller (``functions.text.rx``).
"""

# --- line cleaning ----------------------------------------------------------
HEADER_LINES = ("POLICY WORDING", "PROSPECTUS", "BROCHURE", "POLICY WORDINGS")
ADMIN_LINES = (
    "record of changes", "change number", "change filed", "comments", "explanation of changes",
)
DATE_LINE = (
    r"^\s*(\d{1,2}/\d{1,2}/\d{2,4})"
    r"|^\s*(January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},\s+\d{4}"
)
PAGE_LINE = r"^\s*(Page\s+\d+|\d+\s*)\s*$"
SEPARATOR_LINE = r"^[-_=]{4,}$"
URL = r"https?://\S+|www\.\S+"
# one-to-one: minus sign, double quotes, apostrophe
TYPOGRAPHY_FROM = "−“”’"
TYPOGRAPHY_TO = "-\"\"'"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
BULLET_GLYPH = r"^(\s*)[•◦▪▫●○■□]\s*"
TOC_DOTS = r"\.{4,}"
TOC_SPACED_DOTS = r"(?:\.\s*){5,}"
TOC_ENTRY = r"^\s*\d+(?:-\d+){1,3}\.?\s+.{3,100}\s+\d+(?:-\d+){1,3}\.?\s*$"
TOC_MAX_DOTS = 10
COLUMN_GAP = r" {2,}"
COLUMN_MIN_CELLS = 3
COLUMN_MAX_CELL = 60

# --- headings and lines -----------------------------------------------------
SECTION_ID = r"^\s*(?:section\s+)?(\d+(?:[.-]\d+){0,4})\.?\s*$"
SECTION_HEADING = r"^\s*(?:section\s+)?(\d+(?:[.-]\d+){0,4})\.?\s*[:-]?\s*(.{3,120})$"
NUMBERED_HEADING = (
    r"^\s*(?:section\s+)?\d+(?:[.-]\d+){0,4}\.?\s*[:-]?\s*[A-Z][A-Za-z0-9,/()' -]{0,120}$"
)
LEADING_LABEL = r"^\s*([a-z]|\d+)\.\s+"
GARBAGE_TITLES = (r"^[0-9\-\(\)\sK\.]+$", r"^[A-Z]-\d+$")
BULLET_LINE = (
    r"^\s*(?:-\s+|\(?[a-zA-Z]\)\s+|[a-zA-Z]\.\s+|\(?[ivxIVX]{1,4}\)\s+|[ivxIVX]{1,4}\.\s+"
    r"|\(?\d{1,3}\)\s+|\d{1,3}\.\s+)"
)
LIST_LABEL = r"^\s*(?:[ivxIVX]+|[a-zA-Z]|\d+)\.\s*$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
CONNECTORS = ("and", "or", "for", "the", "of", "in", "to", "with", "on")
HEADING_MIN, HEADING_MAX, HEADING_RATIO = 2, 120, 0.75
MAX_LEVELS = 5

# --- chunks -----------------------------------------------------------------
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9(])"
MAX_CHARS = 1000
MIN_MERGE = 120
MERGE_FACTOR = 1.4
BULLET_FACTOR = 1.5
NAME_TAIL = r"_(?:policy|wording|prospectus|cis|claim|form|bond|uin).*"
HAS_NUMBER = r"\d"
HAS_PERCENT = r"\d+(\.\d+)?\s*%"
HAS_DURATION = r"\b\d+\s*(day|days|month|months|year|years|week|weeks|hour|hours)\b"
HAS_MONEY = (
    r"(₹|rs\.?\s?\d|inr\s?\d|\$\s?\d|usd\s?\d|€\s?\d|£\s?\d"
    r"|\d[\d,]*\s?(rs\.?|inr|usd|₹|\$|€|£))"
)
REFERENCE = (
    r"\b((?:Section|Sec\.|Clause|Cl\.|Annexure|Annex\.|Schedule|Sched\.)\s+"
    r"(?:(?:\d+(?:\.\d+)*[a-z]?|[A-Z]+|[I|V|X|L|C|D|M]+)\([a-z0-9]\)"
    r"|(?:\d+(?:\.\d+)*[a-z]?|[A-Z]+|[I|V|X|L|C|D|M]+)\b))"
)
QUESTION = r"\b(what|how|why|when|who|where|is\s+there|can\s+i)\b.*\?"
DEFINITION = r"^\s*\"?[A-Z][a-zA-Z\s]{1,30}\"?\s+(means|refers to|shall mean)\b"
SEMANTIC_KEYWORDS = {
    "faq": ("faq", "frequently asked questions", "q&a", "questions and answers"),
    "exclusion": ("exclusion", "exclusions", "exclude", "excluded", "not covered",
                  "what is not covered", "permanent exclusion"),
    "waiting_period": ("waiting period", "waiting periods", "wait period", "wait periods",
                       "survival period"),
    "claim_process": ("claim process", "claims procedure", "claim settlement", "reimbursement",
                      "cashless", "how to claim", "claim notification", "claim form",
                      "submitting claim"),
    "premium": ("premium", "premiums", "premium rate", "premium payment", "payment of premium",
                "grace period"),
    "eligibility": ("eligibility", "eligible", "age limit", "entry age", "maximum age",
                    "who can buy", "who is eligible"),
    "hospital_network": ("network hospital", "network provider", "network clinic",
                         "hospital network", "non-network", "preferred provider",
                         "cashless facility"),
    "benefit": ("benefit", "benefits", "sum insured", "restore benefit", "reinsurance",
                "cumulative bonus", "no claim bonus", "maternity benefit"),
    "coverage": ("coverage", "coverages", "cover", "scope of cover", "what we cover",
                 "hospitalization cover", "in-patient cover"),
    "contact": ("helpline", "toll-free", "customer care", "email support", "contact us",
                "phone number", "website", "address", "call center"),
}
CARRY_PREFIXES = ("section", "clause", "scope", "table", "exclusion", "benefit", "coverage",
                  "premium", "eligibility", "general", "definitions")
CARRY_KEYWORDS = ("exclusions", "table of benefits", "base covers", "optional covers", "preamble",
                  "definitions", "scope of cover", "benefits", "eligibility", "general conditions")
CARRY_NOISE = ("company limited", "insurance company", "policy wording", "prospectus",
               "customer information", "sheet", "policy document", "page number")
CARRY_GARBAGE = (r"^[\d\.\s]+$", r"^[^\w\s]+$")

# --- documents --------------------------------------------------------------
CARRIER_PREFIXES = ("SBI", "HDFC", "ICICI", "TATA", "BAJAJ", "LIC")
DOCUMENT_TYPES = (
    ("primary_agreement", 100,
     ("wording", "policy wording", "contract", "agreement", "terms and conditions",
      "terms conditions", "statute", "act", "regulation", "bylaw", "constitution",
      "master policy", "plan document", "bond", "policy bond", "policy-bond")),
    ("customer_information_sheet", 95,
     ("customer information sheet", "cis", "key features document", "kfd")),
    ("certificate_or_schedule", 90,
     ("certificate", "schedule", "endorsement", "rider", "addendum", "amendment", "annexure",
      "appendix")),
    ("procedural_guide", 70,
     ("manual", "handbook", "guide", "procedure", "sop", "instructions", "playbook",
      "specification", "spec")),
    ("summary_document", 50,
     ("brochure", "prospectus", "summary", "overview", "factsheet", "fact sheet", "leaflet",
      "highlights", "at a glance")),
    ("reference_document", 40, ("faq", "glossary", "definitions", "reference", "q&a", "qanda")),
    ("marketing_material", 20,
     ("marketing", "flyer", "advertisement", "promo", "presentation", "deck")),
)
DEFAULT_TYPE, DEFAULT_PRIORITY = "general_document", 55
PATH_LOBS = (
    ("health", "Health"), ("motor", "Motor"), ("car", "Motor"), ("two wheeler", "Motor"),
    ("home", "Home"), ("grih", "Home"), ("personal accident", "Personal_Accident"),
    ("cyber", "Cyber"), ("travel", "Travel"), ("group", "Group"), ("protection", "Protection"),
    ("retirement", "Retirement"), ("savings", "Savings"), ("rider", "Riders"),
    ("regulation", "Regulations"), ("pos", "Regulations"), ("handbook", "Regulations"),
)
PATH_CARRIERS = (("sbi", "SBI"), ("hdfc", "HDFC"))
NAME_TYPES = (
    (("brochure",), "Brochure"), (("policy", "wording", "pw"), "Policy Wording"),
    (("guideline",), "Guideline"), (("handbook",), "Handbook"), (("prospectus",), "Prospectus"),
    (("cis",), "Customer Information Sheet"),
)

# --- search -----------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}_]{3,}"
BM25_K1, BM25_B, BM25_FLOOR = 1.5, 0.75, 0.25
CARRIER_ALIASES = (("SBI", "sbi"), ("HDFC", "hdfc"))
LOB_KEYWORDS = (
    ("health", ("health", "medical", "hospital", "mediclaim", "disease", "illness", "treatment",
                "doctor", "copay", "maternity", "pregnancy", "icu", "opd", "waiting period",
                "corona", "rakshak", "surrogacy", "oocyte", "donor", "divyang", "alpha", "edge",
                "easy health")),
    ("motor", ("motor", "car", "package", "bike", "two wheeler", "twowheeler", "vehicle",
               "driver", "own damage", "third party", "tpl", "act only", "residual", "value")),
    ("home", ("home", "house", "grih", "raksha", "building", "structure", "flexi home", "fire",
              "earthquake")),
    ("personal accident", ("accident", "personal accident", "accidental death", "disability",
                           "ptd", "ppd", "saral suraksha", "injury", "injured")),
    ("cyber", ("cyber", "vault", "edge", "hacking", "fraud", "hacker", "phishing",
               "online theft", "digital")),
    ("travel", ("travel", "trip", "flight", "holiday", "baggage", "passport", "visa",
                "medical evacuation")),
    ("group", ("group", "employee", "gratuity", "employer", "credit protect", "shield",
               "master policy", "poorna", "jeevan suraksha")),
    ("protection", ("protection", "term", "death benefit", "click 2 protect", "elite",
                    "supreme", "ultimate", "smart term", "life cover")),
    ("retirement", ("retirement", "pension", "annuity", "immediate annuity",
                    "systematic pension", "age-at-entry")),
    ("savings", ("savings", "fixed maturity", "sanchay", "wealth", "sampoorn", "sampoorna",
                 "par advantage", "income plan", "invest")),
    ("rider", ("rider", "add-on", "addon", "cash benefit", "waiver of premium",
               "critical illness plus")),
    ("regulations", ("regulation", "guidelines", "pos", "posp", "salesperson", "handbook",
                     "agent", "training")),
)
FUZZY_THRESHOLD = 85.0
FUZZY_MIN_KEYWORD = 6
ADMIN_KEYWORDS = ("document", "documents", "required", "file", "claim", "claims", "form", "forms",
                  "procedure", "process", "checklist")
ADMIN_EXPANSION = " claim form documents checklist required proof submission"
TOP_DENSE = TOP_SPARSE = 25
FUSION_K = 60.0
TOP_FUSED = 15
PER_SIDE = 8
WEIGHT_SEMANTIC, WEIGHT_AUTHORITY, WEIGHT_NUMERIC = 0.65, 0.25, 0.10
NUMERIC_HIT = r"(?:rs\.?|inr|₹|\d+%|\d+\.\d+|\btable\b)"
NUMERIC_FULL = 8.0
PROCEDURAL = ("claim form", "basic documentation", "documents in support", "claimant's identity",
              "death certificate", "death registration", "police report")
PROCEDURAL_BOOST = 0.35
PRODUCT_NAMES = ("sanchay aajeevan", "sanchay plus", "sanchay par", "fixed maturity",
                 "saral suraksha", "corona rakshak", "click 2 protect", "group term",
                 "health protector", "smart pension", "livewell", "group health shield",
                 "group illness")
PRODUCT_BOOST = 0.40
CONFIDENCE, REJECT_MARGIN = 0.70, 0.20
MAX_PER_DOCUMENT, TOP_FINAL = 3, 5
STITCHED, STITCH_CHARS = 2, 400
TOKEN_BUDGET, CHARS_PER_TOKEN = 3500, 4
BGE_INSTRUCTION = "Represent this sentence for searching relevant passages: "

# --- answers ----------------------------------------------------------------
HISTORY_TURNS = 3
EXCERPT_MIN, EXCERPT_LINES = 40, 5
NO_ANSWER = (
    "I could not find a definitive answer in the official policy documents. "
    "Would you like me to raise a ticket for a support specialist?"
)

# --- evaluation -------------------------------------------------------------
KEYWORD_HIT = 0.65
DUPLICATE_JACCARD = 0.85
BOILERPLATE_TERMS = ("address", "phone", "email", "ombudsman", "ombudsmen", "toll free",
                     "tollfree", "corporate office", "registered office")
LAYOUT_HEADINGS = ("days", "yrs", "adults", "title", "description", "na")
ENTITY_PATTERNS = (  # (pattern, ignore case)
    (r"\b\d+(?:,\d+)*(?:\.\d+)?\b", True),
    (r"\bRs\.\s*\d+(?:,\d+)*\b", True),
    (r"\b\d+%\b", True),
    (r"\b\d+\s*(?:days|months|years|lakhs|lakh)\b", True),
    (r"\b[A-Z]{3,5}\b", False),
    (r"\b[a-zA-Z]+\s+(?:treatment|benefit|policy|period|grant|cover|charges|fee|limit|donor"
     r"|hospitalization|exclusion|disease|consult|cancellation|age|copay|co-pay)\b", True),
)
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
CAPITALISED_STOP = ("the", "this", "my", "if", "there", "does", "what", "is", "are", "we", "how",
                    "can")
CITATION = r"\bpage\s*(\d+)\b"
CITATION_LOOKBACK = 100
HEADING_STOP = ("policy", "wording", "general", "insurance", "limited", "company", "clause",
                "section", "number")
EVAL_BOILERPLATE = (
    "corporate office", "registered office", "regd office", "tollfree", "cin:", "irdai",
    "lotus park", "wagle industrial", "mumbai", "floor", "road", "tel:", "phone", "email",
    "ombudsman", "grievance", "customer care", "bima bharosa", "stage 1", "stage 2", "stage 3",
    "stage 4", "available 24/7", "servicing", "things to", "description", "no. title",
    "terms and", "insurance company limited", "customer.care", "ombudsmen", "annexure i",
    "annexure-i", "list of", "tel.", "toll free", "sonepat", "telangana", "lakshadweep",
    "c.r. avenue", "vasofix safety", "optional", "cumulative",
)
EVAL_TEXT_BOILERPLATE = ("corporate & registered office", "u66000mh", "tollfree", "customer.care@")
EVAL_MIN_CHARS, EVAL_SIZE = 60, 100
EVAL_TEMPLATES = {
    "exclusion": "What are the exclusions under {}?",
    "benefit": "Explain the coverage and benefits for {}.",
    "coverage": "Explain the coverage and benefits for {}.",
    "waiting_period": "What is the waiting period for {}?",
    "eligibility": "What is the eligibility criteria for {}?",
    "claim_process": "How to file a claim or process claims for {}?",
    "definition": "Define the term {} under definitions.",
    "other": "What is the policy details for {}?",
    "relaxed": "Details about {}",
}
EVAL_NUMBER = r"\b\d+(?:\.\d+)?\s*%?"
EVAL_DURATION = r"\b\d+\s*(?:day|days|month|months|year|years|week|weeks|hour|hours)\b"
EVAL_MONEY = r"(?:₹|rs\.?|inr)\s*\d+[\d,]*"
RANK_STOP = ("policy", "policies", "insurance", "under", "about", "wording", "wordings", "what",
             "where", "when", "does")
ROUTING_STOP = ("policy", "policies", "insurance", "under", "about", "wording", "wordings")
RANK_BOILERPLATE = ("cin:", "u66000mh", "tollfree", "toll free", "customer care",
                    "customer.care", "email:", "website:", "registered office",
                    "corporate office", "regd office", "irdai reg", "lotus park",
                    "wagle industrial")
INTENT_BOOST, ROUTED, MISROUTED = 1.25, 2.0, 0.1
SUBQUERY_WEIGHT = 0.5
GRID_STEP = 0.05
FAILURES = ("Boilerplate/Contact Detail", "Layout/Parser Noise", "Recall Failure (Empty Results)",
            "Recall Failure (Wrong Document Policy Routed)",
            "Ranking/Reranker Optimization Failure", "None (Hit)")
EXPECTED_DOCUMENT = (("SBI", ("sbi", "saral")), ("HDFC", ("hdfc", "click", "health protector")))

# --- diagnostics and application tables -------------------------------------
COMPLETENESS_KEYS = ("document_id", "source", "relative_path", "document_type",
                     "document_priority", "section_number", "section_title", "heading_path",
                     "chunk_type", "page_start", "page_end")
LARGEST = 10
HISTORY_MESSAGES = 7
TITLE_CHARS = 50
RECENT_THREADS, RECENT_DOCUMENTS = 8, 7
ERROR_CHARS = 1000
LOW_TEXT_CHARS = 20
SPLIT_TOKENS, SPLIT_OVERLAP = 800, 150
CHILD_CHARS, CHILD_OVERLAP = 350, 75
SECTION_CHARS, SUB_CHARS, SUB_OVERLAP = 1800, 1500, 250
