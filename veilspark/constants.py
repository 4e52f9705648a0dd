"""Patterns, word lists and tables that decide the results.

Everything in this file is data that must hold exactly these values for
results to be right; the logic that uses them lives elsewhere.
"""

# --- fixed values: one pattern per identifier type, in evaluation order -------
PATTERNS = {
    "AADHAAR": r"\b(\d{4}[\s-]?\d{4}[\s-]?\d{4})\b",
    "PAN": r"\b([A-Z]{5}\d{4}[A-Z])\b",
    "PHONE_NUMBER": r"\b(?:\+91[\s-]?)?([6-9]\d{9})\b",
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PASSPORT": r"\b([A-Z]\d{7})\b",
    "BANK_ACCOUNT": r"\b(\d{9,18})\b",
    "IFSC": r"\b([A-Z]{4}0[A-Z0-9]{6})\b",
    "UPI_ID": r"\b([A-Za-z0-9._%+-]+@[A-Za-z][A-Za-z0-9]*)\b",
    "VOTER_ID": r"\b([A-Z]{2}/\d{2}/\d{3}/\d{6})\b",
}
PAIR_PATTERN = r"([\w.]+)\s*:\s*(.+?)(?=\s+\||$)"

# --- fixed values: confidence of a raw hit ------------------------------------
CONFIDENCE = {
    "AADHAAR": 0.95,
    "PAN": 0.95,
    "PHONE_NUMBER": 0.85,
    "EMAIL_ADDRESS": 0.95,
    "PASSPORT": 0.80,
    "BANK_ACCOUNT": 0.70,
    "IFSC": 0.85,
    "UPI_ID": 0.85,
    "VOTER_ID": 0.90,
}
NER_CONFIDENCE = {"PERSON_NAME": 0.85, "ADDRESS": 0.70}
STRUCTURED_CONFIDENCE = 0.95
LABEL_BOOST = 0.1

# --- fixed values: context ----------------------------------------------------
CONTEXT_WINDOW = 120
NER_CHUNK_CHARS = 100_000

CONTEXT_KEYWORDS = {
    "AADHAAR": ["aadhaar", "aadhar", "adhar", "uid", "uidai"],
    "PAN": ["pan", "permanent account", "pan_number", "pan_no", "pan card"],
    "PHONE_NUMBER": [
        "phone", "mobile", "cell", "contact", "ph", "mob", "telephone", "tel", "+91",
    ],
    "EMAIL_ADDRESS": ["email", "e-mail", "mail"],
    "PASSPORT": ["passport", "passport_number", "passport_no"],
    "BANK_ACCOUNT": [
        "account", "acct", "a/c", "bank", "bank_account", "account_number", "acc_no",
    ],
    "PERSON_NAME": [
        "name", "person", "customer", "employee", "patient", "student", "applicant",
        "first_name", "last_name", "full_name",
    ],
    "ADDRESS": [
        "address", "addr", "location", "city", "state", "street", "pincode", "zip",
        "residential",
    ],
    "IFSC": ["ifsc", "ifsc_code", "bank_code", "branch_code"],
    "UPI_ID": ["upi", "upi_id", "vpa", "virtual_payment"],
    "VOTER_ID": ["voter", "voter_id", "electoral", "election_id"],
}

# Types that need a keyword or label nearby; the others stand on their pattern.
CONTEXT_REQUIRED = [
    "PHONE_NUMBER", "BANK_ACCOUNT", "PERSON_NAME", "ADDRESS", "IFSC", "UPI_ID",
]
SELF_EVIDENT = ["AADHAAR", "PAN", "EMAIL_ADDRESS", "PASSPORT", "VOTER_ID"]

NAME_PARTS = [
    "name", "person", "customer", "employee", "patient", "student", "applicant",
]
NAME_SUPPRESS_PARTS = [
    "location", "street", "city", "state", "country", "coordinates", "timezone",
    "postcode", "title", "id",
]
ADDRESS_PARTS = ["address", "addr", "street", "residential"]
NON_PII_PARTS = [
    "login", "password", "salt", "md5", "sha1", "sha256", "uuid", "username", "picture",
    "thumbnail", "large", "medium", "coordinates", "latitude", "longitude", "timezone",
    "offset", "description", "nat", "gender", "title", "age", "date", "registered", "dob",
    "postcode", "id",
]
GEO_EXCLUSIONS = [
    "india", "in", "usa", "uk", "us", "china", "brazil", "south africa", "canada",
    "australia", "adelaide", "darwin", "bombay", "calcutta", "madras", "new delhi",
    "sri jayawardenepura", "colombo", "dhaka", "almaty", "kabul", "tehran", "abu dhabi",
    "muscat", "baku", "tbilisi", "guam", "samoa", "lima", "azores", "cape verde islands",
    "copenhagen", "hawaii", "alaska", "midway island",
]

# --- fixed values: risk -------------------------------------------------------
HIGH_RISK = ["AADHAAR", "PAN", "PASSPORT", "BANK_ACCOUNT", "VOTER_ID", "IFSC"]
MEDIUM_RISK = ["PHONE_NUMBER", "EMAIL_ADDRESS", "UPI_ID"]
LOW_RISK = ["PERSON_NAME", "ADDRESS"]

# --- fixed values: tokens -----------------------------------------------------
TOKEN_PREFIX = {
    "PERSON_NAME": "PERSON",
    "PHONE_NUMBER": "PHONE",
    "EMAIL_ADDRESS": "EMAIL",
    "AADHAAR": "AADHAAR",
    "PAN": "PAN",
    "BANK_ACCOUNT": "BANK",
    "ADDRESS": "ADDR",
    "PASSPORT": "PASSPORT",
    "IFSC": "IFSC",
    "UPI_ID": "UPI",
    "VOTER_ID": "VOTER",
}
DECRYPTION_ERROR = "[DECRYPTION_ERROR]"

# --- fixed values: files and governance ---------------------------------------
ALLOWED_TYPES = ["csv", "json", "sql", "pdf", "docx", "doc"]
FILE_STATUSES = ["uploaded", "processing", "completed", "failed"]
AUDIT_PAGE_SIZE = 500

# --- our own choices ----------------------------------------------------------
# Phone pattern used unless DetectConfig.strict: keeps the country code.
RELAXED_PHONE = r"(?<![\w+])(?:\+91[\s-]?)?[6-9]\d{9}\b"

# Shape of a person name for the built-in recogniser: two or three capitalised words.
PERSON_SHAPE = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}\b"

# Place names the built-in recogniser knows.
PLACES = [
    "Agra", "Ahmedabad", "Ajmer", "Amritsar", "Bandra West", "Bengaluru", "Bhopal",
    "Bhubaneswar", "Chandigarh", "Chennai", "Coimbatore", "Connaught Place", "Dehradun",
    "Faridabad", "Goa", "Gujarat", "Gurugram", "Guwahati", "Hyderabad", "Indore", "Jaipur",
    "Jodhpur", "Kanpur", "Karnataka", "Kerala", "Kochi", "Kolkata", "Lucknow", "Ludhiana",
    "Maharashtra", "Mangaluru", "Mumbai", "Mysuru", "Nagpur", "Nashik", "New Delhi",
    "Panchkula", "Patna", "Puducherry", "Pune", "Punjab", "Rajasthan", "Ranchi", "Shimla",
    "Srinagar", "Surat", "Tamil Nadu", "Telangana", "Thane", "Udaipur", "Vadodara",
    "Varanasi", "Vijayawada", "Visakhapatnam", "Berlin", "Dubai", "London", "New York",
    "Paris", "Singapore", "Tokyo",
]

# Order in which candidates of equal weight win, and the type list itself.
RANK = {name: i + 1 for i, name in enumerate(PATTERNS)}
NER_RANK = len(PATTERNS) + 1
STRUCTURED_RANK = len(PATTERNS) + 2
PII_TYPES = [*PATTERNS, "PERSON_NAME", "ADDRESS"]
