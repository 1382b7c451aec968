"""Patterns and names that results depend on.

Everything in this module is a fixed value: detection patterns, kind names, placeholder prefixes and
limits have to be what they are for results to be right.
"""

from __future__ import annotations

# Detection patterns.
EMAIL = r"(?i)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?:(?:\+|00)\d{1,3}[\s\-./]?|\(\d{2,6}\)[\s\-./]?|0\d{1,4}[\s\-./])\d[\d\s\-./]{3,20}\d"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Za-z0-9 ]{11,30}"
CARD = r"\d{4}(?:[ \-]\d{4}){2,4}|\d{13,19}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
IPV6 = r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f.]{0,4}){2,7}"
DATE = r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b|\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
TOKEN = r"\b([A-Z][A-Z0-9_]*_[0-9]+)\b"

# Heuristics against prompt injection.
INJECTION = [
    r"(?i)ignore (all |the )?(previous |prior |above )?instructions",
    r"(?i)disregard (the )?(above|previous|prior|system)",
    r"(?i)system prompt",
    r"(?i)you are now",
    r"(?i)pretend (to be|you are)",
    r"(?i)jailbreak",
    r"(?i)\bDAN\b mode",
    r"(?i)ignore your (guidelines|rules|programming)",
    r"(?i)act as if",
]

# The order of recognizers (ties go to the first), kinds and placeholder prefixes.
RECOGNIZERS = ["email", "iban", "credit_card", "phone", "ip_address", "datetime"]
KIND_OF = {"email": "EMAIL_ADDRESS", "iban": "IBAN_CODE", "credit_card": "CREDIT_CARD", "phone": "PHONE_NUMBER", "ip_address": "IP_ADDRESS", "datetime": "DATE_TIME"}
PREFIX_OF = {
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "IBAN_CODE": "IBAN",
    "CREDIT_CARD": "CARD",
    "PERSON": "PERSON",
    "ORGANIZATION": "ORG",
    "LOCATION": "LOCATION",
    "IP_ADDRESS": "IP",
    "DATE_TIME": "DATE",
    "NATIONAL_ID": "NID",
    "NRP": "NRP",
}
ALIASES = {"EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "IBAN": "IBAN_CODE", "CC": "CREDIT_CARD", "CARD": "CREDIT_CARD", "ORG": "ORGANIZATION", "LOC": "LOCATION", "IP": "IP_ADDRESS", "DATE": "DATE_TIME"}
CONTACT_KINDS = ["EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "NATIONAL_ID"]

# Limits.
RETRIABLE = [429, 502, 503, 504]
META_KEYS, META_KEY_CHARS, META_VALUE_CHARS = 16, 64, 256
TOP_DIMENSIONS, TOP_CHART = 50, 8
TRACE_FIELD_BYTES = 64 * 1024
DURATION_BOUNDS = [0.01 * 2**k for k in range(14)]
TOKEN_BOUNDS = [float(4**k) for k in range(14)]
