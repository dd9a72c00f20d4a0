"""Fixed values of the categorisation contract, kept together as plain text."""

# --- operation types: channel -> type ---------------------------------------
OPERATION_TYPES = {"CB": "card", "PRLV": "direct_debit", "VIR": "transfer"}
UNKNOWN_OPERATION = "unknown"

# --- masking ------------------------------------------------------------------
IBAN_PATTERN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
RUM_PATTERN = r"(?i)\bRUM[\w-]{8,}\b"
IBAN_TOKEN = "IBAN_TOKEN"
RUM_TOKEN = "RUM_TOKEN"

# --- merchant code -> category ------------------------------------------------
MCC_CATEGORIES = {
    5411: "Groceries",
    5814: "Restaurants",
    4111: "Transport",
    4900: "Utilities",
    6513: "Rent",
    6011: "Salary",
}

# --- ordered keyword -> category (the first contained keyword wins) -----------
KEYWORD_CATEGORIES = [
    ("loyer", "Rent"),
    ("foncia", "Rent"),
    ("nexity", "Rent"),
    ("edf", "Utilities"),
    ("engie", "Utilities"),
    ("orange", "Utilities"),
    ("sfr", "Utilities"),
    ("free", "Utilities"),
    ("ratp", "Transport"),
    ("sncf", "Transport"),
    ("uber", "Transport"),
    ("bolt", "Transport"),
    ("total", "Transport"),
    ("totalenergies", "Transport"),
    ("carrefour", "Groceries"),
    ("auchan", "Groceries"),
    ("intermarche", "Groceries"),
    ("monoprix", "Groceries"),
    ("casino", "Groceries"),
    ("mcdo", "Restaurants"),
    ("mcdonald", "Restaurants"),
    ("burger", "Restaurants"),
    ("kfc", "Restaurants"),
    ("starbucks", "Restaurants"),
    ("quick", "Restaurants"),
    ("salaire", "Salary"),
    ("payroll", "Salary"),
]
INVOICE_PATTERN = r"\bfacture\b"
INVOICE_OPERATORS = ["edf", "engie", "orange", "sfr", "free"]
SALARY_PATTERN = r"\bsalaire\b|\bpayroll\b"
RENT_PATTERN = r"\bloyer\b"

# --- payment words removed before merchant matching ---------------------------
PAYMENT_WORDS = [
    "cb", "tpe", "pdv", "visa", "mastercard", "transaction",
    "paiement", "sepa", "prlv", "vir", "paylib", "applepay",
]

# --- label -> hint words of the fallback scorer -------------------------------
CATEGORY_HINTS = {
    "Groceries": ["carrefour", "auchan", "intermarche", "monoprix", "casino", "super", "market"],
    "Restaurants": ["mcdo", "mcdonald", "burger", "kfc", "restaurant", "pizza", "cafe"],
    "Transport": ["ratp", "sncf", "uber", "bolt", "total", "station", "essence", "tpe", "toll"],
    "Utilities": ["edf", "engie", "orange", "sfr", "free", "facture"],
    "Rent": ["loyer", "foncia", "nexity"],
    "Salary": ["salaire", "payroll", "paie", "salary"],
}
CATEGORIES = ["Groceries", "Rent", "Restaurants", "Salary", "Transport", "Utilities"]

# --- latency-style bucket bounds ----------------------------------------------
HISTOGRAM_BOUNDS = [5, 10, 20, 40, 80, 160, 320, 640, 1280]

# --- acceptance gates: metric, direction, bound --------------------------------
QUALITY_GATES = [
    ("macro_f1", "min", 0.82),
    ("coverage", "min", 0.90),
    ("p95", "max", 80.0),
    ("fallback_rate", "max", 0.15),
    ("psi", "max", 0.20),
    ("shift", "max", 0.15),
]

# --- image files that count as images -------------------------------------------
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp"]

# --- whitespace: Unicode blanks and separators, same class in Java and RE2 ------
BLANK = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# --- ASCII spellings of lower-case letters and signs with no one-letter base ----
# (single letters with marks are derived by rule, see functions/text.py)
ASCII_SPELLINGS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th",
    "ħ": "h", "ı": "i", "ł": "l", "ŋ": "ng", "ŧ": "t",
    "€": "EUR", "£": "PS", "©": "(c)", "®": "(r)", "°": "deg", "±": "+-",
    "«": "<<", "»": ">>", "×": "x", "÷": "/", "µ": "u", "·": "*",
    "²": "2", "³": "3", "¹": "1", "ª": "a", "º": "o", "¿": "?", "¡": "!",
    "´": "'", "‘": "'", "’": "'", "“": '"', "”": '"', "„": ",,",
    "–": "-", "—": "--", "…": "...", "•": "*",
}

# --- compatibility forms that spell several ASCII characters or a digit -----------
COMPATIBILITY_SPELLINGS = {
    "²": "2", "³": "3", "¹": "1", "ª": "a", "º": "o", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi",
    "ﬄ": "ffl", "ĳ": "ij", "Ĳ": "IJ", "™": "TM", "½": "1 2", "¼": "1 4", "¾": "3 4",
}

# --- English stop words dropped by the document tokenisers -----------------------
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
