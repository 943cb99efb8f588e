"""Rule tables. The values marked "fixed" decide results and are stated as they must be."""

from __future__ import annotations

from dataclasses import dataclass

# Message categories, in rule priority order; the default comes last.
CATEGORIES = ("marketing", "transactional", "survey", "customer_support", "personal")
DEFAULT_CATEGORY = "personal"

# Category keywords, looked up as lower-case substrings, first category wins.
CATEGORY_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("marketing", ("unsubscribe", "newsletter", "promotion", "offer", "sale", "discount")),
    ("transactional", ("order", "receipt", "confirmation", "invoice", "payment", "account")),
    ("survey", ("survey", "feedback", "questionnaire", "rate", "review")),
    ("customer_support", ("support", "help", "ticket", "issue", "problem", "assistance")),
)

# Words that mark the end of a message as a footer.
FOOTER_INDICATORS = (
    "unsubscribe", "privacy policy", "terms of service", "contact us", "copyright", "©",
    "all rights reserved", "company", "address", "phone", "email",
)

# Class names of footer-like elements.
FOOTER_CLASSES = ("footer", "bottom", "signature")

# First labels that are ignored when two domains are compared.
MAIL_PREFIXES = ("mail", "email", "smtp", "noreply", "no-reply")

# Places where a site usually keeps its privacy policy, in order of trial.
PRIVACY_PATHS = (
    "/privacy", "/privacy-policy", "/privacy_policy", "/privacypolicy", "/legal/privacy",
    "/terms/privacy", "/policy/privacy", "/privacy.html", "/privacy.php",
)

# What makes a link on a site's first page a privacy link, in order of trial.
PRIVACY_HREF_WORDS = ("privacy", "Privacy")
PRIVACY_TEXT_WORDS = ("privacy policy", "privacy", "data protection")

# Patterns.
VALID_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
FOUND_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
TEXT_URL = r"""https?://[^\s<>"']+[^\s<>"'.,)]"""
COMPANY_NAME = r"\b[A-Z][a-zA-Z\s&.,]+(?:Inc|LLC|Corp|Company|Ltd|Limited)\b"
STREET_ADDRESS = (
    r"\d+\s+[A-Za-z\s,]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln)"
)
COMPANY_PHONE = r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"

# Text put in place of a removed span.
REDACTED = "[REDACTED]"

# Required keys of a raw message.
REQUIRED_KEYS = ("from", "subject", "html_content")


@dataclass(frozen=True)
class PiiRule:
    """One pattern of one entity type.

    ``needs`` and ``digits`` say what every hit contains: a text, and a run of so many digits.
    Rows without these skip the pattern.
    """

    name: str
    entity_type: str
    pattern: str
    score: float
    needs: str = ""
    digits: int = 0


# Names, patterns and scores of personal data, in the order in which text is rewritten.
PII_RULES: tuple[PiiRule, ...] = (
    PiiRule("visa", "CREDIT_CARD", r"\b4[0-9]{12}(?:[0-9]{3})?\b", 0.9, digits=13),
    PiiRule("mastercard", "CREDIT_CARD", r"\b5[1-5][0-9]{14}\b", 0.9, digits=16),
    PiiRule("amex", "CREDIT_CARD", r"\b3[47][0-9]{13}\b", 0.9, digits=15),
    PiiRule("email", "EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9, needs="@"),
    PiiRule(
        "us_phone", "PHONE_NUMBER",
        r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b", 0.8, digits=4,
    ),
    PiiRule("international_phone", "PHONE_NUMBER", r"\+[1-9]\d{1,14}\b", 0.7, needs="+"),
    PiiRule("ssn", "SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85, digits=4),
)

# Least score per entity type; other types use the general threshold.
ENTITY_THRESHOLDS: tuple[tuple[str, float], ...] = (
    ("EMAIL_ADDRESS", 0.5), ("PHONE_NUMBER", 0.4), ("CREDIT_CARD", 0.8),
    ("PERSON", 0.5), ("ORGANIZATION", 0.4), ("LOCATION", 0.4),
)

# How each entity type is rewritten by default.
DEFAULT_REWRITES: tuple[tuple[str, str], ...] = (
    ("PERSON", "replace"), ("EMAIL_ADDRESS", "mask"), ("PHONE_NUMBER", "mask"),
    ("CREDIT_CARD", "mask"), ("ORGANIZATION", "replace"), ("LOCATION", "replace"),
    ("DATE_TIME", "replace"),
)

# Named-entity labels of a language model and the entity type each stands for.
NER_LABELS: tuple[tuple[str, str], ...] = (
    ("PERSON", "PERSON"), ("PER", "PERSON"), ("ORG", "ORGANIZATION"), ("GPE", "LOCATION"),
    ("LOC", "LOCATION"), ("NORP", "NRP"), ("FACILITY", "LOCATION"), ("EVENT", "EVENT"),
    ("FAC", "LOCATION"), ("PRODUCT", "PRODUCT"), ("WORK_OF_ART", "PRODUCT"), ("LAW", "LAW"),
    ("LANGUAGE", "LANGUAGE"), ("DATE", "DATE_TIME"), ("TIME", "DATE_TIME"),
    ("PERCENT", "PERCENT"), ("MONEY", "MONEY"), ("QUANTITY", "QUANTITY"),
    ("ORDINAL", "ORDINAL"), ("CARDINAL", "CARDINAL"),
)


@dataclass(frozen=True)
class DpoWords:
    """Words near a data-protection address. The defaults are fixed values."""

    officer: str = r"data\s+protection\s+officer|dpo"
    protection: str = r"data\s+protection|dpo"
    privacy: str = "privacy"

    def patterns(self) -> tuple[str, ...]:
        """Four patterns in order of trust; group 1 is the address."""
        before, after = r"[\s\S]{0,100}?", r"[\s\S]{0,50}?"
        return (
            f"(?i)(?:{self.officer}){before}({FOUND_EMAIL})",
            f"(?i)({FOUND_EMAIL}){after}(?:{self.protection})",
            f"(?i)(?:{self.privacy}){before}({FOUND_EMAIL})",
            f"(?i)({FOUND_EMAIL}){after}(?:{self.privacy})",
        )
