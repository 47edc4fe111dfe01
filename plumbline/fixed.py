"""Fixed values.

Everything in this file is a constant whose value decides a result: patterns,
word lists, code lists, default thresholds, category and dimension maps. They
are stated as plain text, in natural order, and nothing is computed here.
"""

# --- Fixed values: text patterns ---------------------------------------------
# \A and \z instead of ^ and $, because Java's $ also matches before a final
# line break.

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
IP4 = (
    r"(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\."
    r"(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
)
IP6_FULL = r"([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
IP6 = (
    r"(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|([0-9a-fA-F]{1,4}:){1,7}:"
    r"|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}"
    r"|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}"
    r"|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}"
    r"|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})"
    r"|:((:[0-9a-fA-F]{1,4}){1,7}|:))"
)
US_PHONE = r"\+?1?[-.]?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}"
US_ZIPCODE = r"[0-9]{5}(-[0-9]{4})?"
PERSON_NAME = r"[A-Za-z]+([ '-][A-Za-z]+)*"
WHITESPACE_ONLY = r"\A\s+\z"
SURROUNDED_BOTH = r"(?s)\A\s+.*\s+\z"
SURROUNDED_BEFORE = r"\A\s+[^\s]+"
SURROUNDED_AFTER = r"[^\s]+\s+\z"
INTEGER_TEXT = r"\A-?[0-9]+\z"
DECIMAL_TEXT = r"\A-?[0-9]+(\.[0-9]+)?\z"
BARE_DECIMAL_TEXT = r"\A-?[0-9]*\.[0-9]+\z"
DATE_DASHED_YMD = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATE_SLASHED = r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z"
DATE_DASHED_DMY = r"\A[0-9]{2}-[0-9]{2}-[0-9]{4}\z"
DEFAULT_DATE_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"

# --- Fixed values: formats an inference may report, in order of preference ----

INFERRED_FORMATS = {
    "email": r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z",
    "uuid": r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    "iso_date": r"\A\d{4}-\d{2}-\d{2}\z",
    "iso_datetime": r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\z",
    "e164": r"\A\+[1-9]\d{6,14}\z",
    "url": r"\Ahttps?://[A-Za-z0-9.-]+(?::\d+)?(?:/.*)?\z",
}

# Patterns a declared format turns into when a check is proposed for it.
DECLARED_FORMATS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}$",
    "iso_datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "e164": r"^\+[1-9]\d{6,14}$",
    "url": r"^https?://[A-Za-z0-9.-]+",
}

# --- Fixed values: word lists ---------------------------------------------------

NULL_PLACEHOLDERS = ["NULL", "N/A", "NA", "NONE", "NIL", "EMPTY", "MISSING"]
BOOLEAN_WORDS = ["TRUE", "FALSE", "YES", "NO", "1", "0", "T", "F"]
DETECTED_BOOLEAN_WORDS = ["TRUE", "FALSE", "YES", "NO", "1", "0"]

TEXT_TYPES = ["string", "text", "varchar", "char", "str"]
NUMERIC_TYPES = ["number", "integer", "float", "int", "numeric", "decimal", "double"]
DATE_TYPES = ["date", "datetime", "timestamp", "timestamptz", "time"]

# --- Fixed values: ISO 4217 currency codes ---------------------------------------

CURRENCY_CODES = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL
BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP
ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS
INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD
LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK
NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK
SGD SHP SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH
UGX USD UYU UZS VED VES VND VUV WST XAF XAG XAU XCD XDR XOF XPD XPF XPT YER ZAR
ZMW ZWL
""".split()

# --- Fixed values: quality dimensions and scoring --------------------------------

DIMENSIONS = [
    "accuracy",
    "completeness",
    "conformity",
    "consistency",
    "coverage",
    "timeliness",
    "validity",
    "uniqueness",
]

CATEGORY_DIMENSION = {
    "nulls": "completeness",
    "volume": "coverage",
    "availability": "coverage",
    "uniqueness": "uniqueness",
    "numeric": "conformity",
    "statistical": "conformity",
    "text": "conformity",
    "patterns": "conformity",
    "pii": "conformity",
    "datatype": "conformity",
    "datetime": "conformity",
    "accepted_values": "validity",
    "boolean": "validity",
    "geographic": "validity",
    "timeliness": "timeliness",
    "change": "timeliness",
    "change_detection": "timeliness",
    "schema": "consistency",
    "comparison": "consistency",
    "referential": "accuracy",
}

# Check types whose dimension is not that of their category.
DIMENSION_OF_CHECK = {
    "text_valid_country_code_percent": "accuracy",
    "text_valid_currency_code_percent": "accuracy",
    "total_row_count_match_percent": "accuracy",
    "total_sum_match_percent": "accuracy",
    "total_min_match_percent": "accuracy",
    "total_max_match_percent": "accuracy",
    "total_average_match_percent": "accuracy",
    "total_not_null_count_match_percent": "accuracy",
    "row_count_match": "accuracy",
    "column_count_match": "accuracy",
    "sum_match": "accuracy",
    "min_match": "accuracy",
    "max_match": "accuracy",
    "mean_match": "accuracy",
    "not_null_count_match": "accuracy",
    "null_count_match": "accuracy",
    "distinct_count_match": "accuracy",
    "column_count": "conformity",
    "column_exists": "conformity",
}

SEVERITY_WEIGHT = {"passed": 0.0, "warning": 1.0, "error": 2.5, "fatal": 5.0}
GREEN_FROM = 80
AMBER_FROM = 60

INCIDENT_SEVERITY = {"warning": "low", "error": "medium", "fatal": "high"}
ALERT_SEVERITY = {"low": "warning", "medium": "error", "high": "fatal", "critical": "fatal"}
ALERT_RANK = {"warning": 1, "error": 2, "fatal": 3}
INCIDENT_MOVES = [
    ("open", "acknowledged"),
    ("open", "resolved"),
    ("acknowledged", "resolved"),
    ("acknowledged", "open"),
    ("resolved", "open"),
]

# --- Fixed values: anomaly fence ----------------------------------------------------

ANOMALY_DAYS = 90
ANOMALY_READINGS = 1000
ANOMALY_MIN_READINGS = 7
ANOMALY_WIDTH = 1.5
