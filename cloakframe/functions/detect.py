"""Detection rules and per-run settings for personal data in free text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: entity -> data element of the token service ----------------------------------------
ENTITY_ELEMENTS = {
    "ACCOUNT_NAME": "string",
    "ACCOUNT_NUMBER": "number",
    "AGE": "number",
    "GENDER": "string",
    "TITLE": "string",
    "PERSON": "string",
    "AMOUNT": "number",
    "BANK_ACCOUNT": "number",
    "CREDIT_CARD": "ccn",
    "CURRENCY": "string",
    "CURRENCY_CODE": "string",
    "CURRENCY_NAME": "string",
    "CURRENCY_SYMBOL": "string",
    "CRYPTO_ADDRESS": "address",
    "DATETIME": "datetime",
    "DOB": "datetime",
    "DRIVER_LICENSE": "number",
    "PASSPORT": "passport",
    "NATIONAL_ID": "nin",
    "SOCIAL_SECURITY_ID": "ssn",
    "EMAIL_ADDRESS": "email",
    "PHONE_NUMBER": "phone",
    "HEALTH_CARE_ID": "number",
    "LOCATION": "address",
    "ADDRESS": "address",
    "IP_ADDRESS": "address",
    "MAC_ADDRESS": "address",
    "URL": "address",
    "TAX_ID": "number",
    "IN_VEHICLE_REGISTRATION": "number",
    "IN_VOTER": "number",
    "IN_GSTIN": "string",
    "PASSWORD": "string",
    "USERNAME": "string",
    "ORGANIZATION": "string",
    "NRP": "number",
    "KR_RRN": "number",
    "TH_TNIN": "nin",
}
SCORE_THRESHOLD = 0.6
MASKING_CHAR = "#"
METHODS = ("redact", "mask")
# ------------------------------------------------------------------------------------------------------

# the token service's element names in terms of our alphabets (ours: its own formats are not public)
ALPHABET_OF = {
    "string": "alnum", "number": "digits", "address": "alnum", "datetime": "digits", "passport": "alnum",
    "nin": "alnum", "ccn": "ccn", "ssn": "ssn", "email": "email", "phone": "phone",
}


def element_of(entity: Column | str) -> Column:
    """Data element of an entity column; NULL for an unknown entity."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITY_ELEMENTS.items() for x in pair]), entity)


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds the entity; ``hint`` is a cheaper pattern that every match contains, tested in the
    JVM so that texts without candidates never reach Python.  Both keep to syntax that all engines share.
    ``check`` names a test of :mod:`.checks` that a match must pass.  A rule with ``terms`` finds whole words and phrases of that
    list instead, the longest at a place; the lists of all rules are searched in one pass."""

    entity: str
    pattern: str
    score: float
    hint: str = ""
    check: str = ""
    terms: tuple[str, ...] = ()


def term_rule(entity: str, terms: str, score: float) -> Rule:
    """A rule for terms given in one string, parted by commas.  Its pattern says the same in regular expressions."""
    listed = tuple(sorted(terms.split(","), key=lambda t: (-len(t), t)))
    return Rule(entity, rf"\b(?:{'|'.join(listed)})\b", score, terms=listed)


# ours: the reference detector is a remote model
RULES = (
    Rule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.95, "@"),
    Rule("URL", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|org|net)\b", 0.7, r"\.(?:com|org|net)"),
    Rule("CREDIT_CARD", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", 0.9, "[0-9]{4}"),
    Rule("IP_ADDRESS", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", 0.85, r"[0-9]\.[0-9]"),
    Rule("PHONE_NUMBER", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b", 0.8, r"\) [0-9]{3}-"),
    Rule("ACCOUNT_NUMBER", r"\b[0-9]{3}-[0-9]{4}\b", 0.62, "[0-9]{3}-[0-9]{4}"),
    Rule("SOCIAL_SECURITY_ID", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.9, "[0-9]-[0-9]{2}-[0-9]"),
    Rule("PASSWORD", r'\b(?:token|password|secret) ?= ?"[^"\[\]]+"', 0.75, '= ?"'),
    Rule("DRIVER_LICENSE", r"\b[0-9]{6,9}\b", 0.4, "[0-9]{6}"),
)


# --- fixed values: lists of public names -----------------------------------------------------------------
CURRENCY_CODES = "USD,EUR,GBP,JPY,CHF,CNY,INR,KRW,THB,BRL,CAD,AUD,NZD,SEK,NOK,DKK,PLN,CZK,HUF,TRY,ZAR,MXN,SGD,HKD,ILS,AED,SAR,RUB"
CURRENCY_NAMES = "dollar,dollars,euro,euros,pound sterling,yen,rupee,rupees,franc,francs,peso,pesos,yuan,krona,krone,zloty,won,baht,rand,real"
GENDERS = "male,female,non-binary,transgender,Male,Female"
TITLES = "Mr,Mrs,Ms,Miss,Dr,Prof,Professor,Sir,Madam,Rev"
PLACES = (
    "Argentina,Australia,Austria,Belgium,Brazil,Canada,Chile,China,Colombia,Czech Republic,Denmark,Egypt,Finland,France,Germany,Greece,Hungary,"
    "India,Indonesia,Ireland,Israel,Italy,Japan,Kenya,Malaysia,Mexico,Netherlands,New Zealand,Nigeria,Norway,Pakistan,Peru,Philippines,Poland,"
    "Portugal,Romania,Russia,Saudi Arabia,Singapore,South Africa,South Korea,Spain,Sweden,Switzerland,Thailand,Turkey,Ukraine,United Kingdom,"
    "United States,Vietnam,Amsterdam,Athens,Bangkok,Barcelona,Beijing,Berlin,Boston,Brussels,Chicago,Dublin,Frankfurt,Hong Kong,London,"
    "Los Angeles,Madrid,Melbourne,Milan,Mumbai,Munich,New Delhi,New York,Paris,Rome,San Francisco,Seoul,Shanghai,Stockholm,Sydney,Tokyo,"
    "Toronto,Vienna,Warsaw,Zurich"
)
# ------------------------------------------------------------------------------------------------------

_PLAIN = {r.entity: r for r in RULES}

#: 34 of the 38 entities.  Numbers that carry check digits must pass them.
CHECKED_RULES = (
    _PLAIN["EMAIL_ADDRESS"],
    _PLAIN["URL"],
    Rule("CREDIT_CARD", _PLAIN["CREDIT_CARD"].pattern, 0.95, "[0-9]{4}", "luhn"),
    Rule("IP_ADDRESS", _PLAIN["IP_ADDRESS"].pattern, 0.9, r"[0-9]\.[0-9]", "octets"),
    _PLAIN["PHONE_NUMBER"],
    _PLAIN["ACCOUNT_NUMBER"],
    Rule("SOCIAL_SECURITY_ID", _PLAIN["SOCIAL_SECURITY_ID"].pattern, 0.92, "[0-9]-[0-9]{2}-[0-9]", "issued_ssn"),
    _PLAIN["PASSWORD"],
    _PLAIN["DRIVER_LICENSE"],
    Rule("BANK_ACCOUNT", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0.95, "[A-Z]{2}[0-9]{2}[A-Z0-9]", "mod97"),
    Rule("CRYPTO_ADDRESS", r"\b[13][1-9A-HJ-NP-Za-km-z]{25,33}\b", 0.95, "[13][1-9A-HJ-NP-Za-km-z]{25}", "base58check"),
    Rule("NATIONAL_ID", r"\b[2-9][0-9]{3} [0-9]{4} [0-9]{4}\b", 0.85, "[0-9] [0-9]{4} [0-9]", "verhoeff"),
    Rule("KR_RRN", r"\b[0-9]{6}-[1-4][0-9]{6}\b", 0.9, "[0-9]-[1-4][0-9]{6}", "rrn"),
    Rule("TH_TNIN", r"\b[1-8]-[0-9]{4}-[0-9]{5}-[0-9]{2}-[0-9]\b", 0.9, "-[0-9]{5}-", "tnin"),
    Rule("IN_GSTIN", r"\b[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", 0.95, "[A-Z]{5}[0-9]{4}[A-Z]", "mod36"),
    Rule("IN_VOTER", r"\b[A-Z]{3}[0-9]{7}\b", 0.65, "[A-Z]{3}[0-9]{7}"),
    Rule("IN_VEHICLE_REGISTRATION", r"\b[A-Z]{2}[ -][0-9]{2}[ -][A-Z]{1,2}[ -][0-9]{4}\b", 0.75, "[A-Z][ -][0-9]{2}[ -][A-Z]"),
    Rule("HEALTH_CARE_ID", r"\b[0-9]{3} [0-9]{3} [0-9]{4}\b", 0.85, "[0-9] [0-9]{3} [0-9]{4}", "weighted11"),
    Rule("TAX_ID", r"\b[0-9]{2}-[0-9]{7}\b", 0.7, "[0-9]-[0-9]{7}"),
    Rule("PASSPORT", r"\b[Pp]assport (?:no\.? |number )?[A-Z][0-9]{7,8}\b", 0.85, "assport "),
    Rule("MAC_ADDRESS", r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b", 0.9, ":[0-9A-Fa-f]{2}:"),
    Rule("DATETIME", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2})?\b", 0.7, "[0-9]{4}-[0-9]{2}-[0-9]{2}", "calendar"),
    Rule("DOB", r"\b(?:[Bb]orn on|[Bb]orn|DOB:?) [0-9]{4}-[0-9]{2}-[0-9]{2}\b", 0.85, "(?:orn|DOB)"),
    Rule("AMOUNT", r"[$€£¥₹] ?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?", 0.75, "[$€£¥₹]"),
    Rule("CURRENCY_SYMBOL", "[$€£¥₹]", 0.4, "[$€£¥₹]"),
    Rule("AGE", r"\b(?:aged [1-9][0-9]?|[1-9][0-9]? years old)\b", 0.75, "(?:aged |years old)"),
    Rule("USERNAME", r"\b(?:user|username|login) ?[=:] ?[A-Za-z0-9_.-]+", 0.75, "(?:user|login)"),
    Rule("ORGANIZATION", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)? (?:Inc|Ltd|LLC|GmbH|Corp)\b", 0.75, "(?:Inc|Ltd|LLC|GmbH|Corp)"),
    Rule("PERSON", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?\b", 0.8, "(?:Mr|Ms|Dr|Prof)"),
    term_rule("CURRENCY_CODE", CURRENCY_CODES, 0.65),
    term_rule("CURRENCY_NAME", CURRENCY_NAMES, 0.65),
    term_rule("GENDER", GENDERS, 0.65),
    term_rule("TITLE", TITLES, 0.65),
    term_rule("LOCATION", PLACES, 0.7),
)


@dataclass(frozen=True)
class TextConfig:
    """Settings of one run; passed in, never global.  ``labels`` names the entities acted on and what
    redaction shows for them; other entities are left as they are, except within merged spans."""

    labels: dict[str, str] = field(default_factory=dict)
    method: str = "redact"
    masking_char: str = MASKING_CHAR
    threshold: float = SCORE_THRESHOLD
    rules: tuple[Rule, ...] = RULES

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, got {self.method!r}")
        if not 0 <= self.threshold <= 1:
            raise ValueError(f"threshold must lie in 0..1, got {self.threshold}")

    @property
    def active(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.score >= self.threshold)

    def candidate(self, text: Column) -> Column:
        """The text where any active rule can match, else NULL.  Lists of terms are searched in every text."""
        if any(r.terms for r in self.active):
            return text
        hints = [r.hint or r.pattern for r in self.active]
        return F.when(text.rlike("|".join(f"(?:{h})" for h in hints)), text) if hints else F.lit(None).cast("string")
