"""Vocabularies of contract extraction. Results must equal them."""

from __future__ import annotations

# Canonical clause titles in order, each with its aliases.
CLAUSES: dict[str, tuple[str, ...]] = {
    "Definitions": ("definitions", "defined terms", "interpretation", "construction"),
    "Confidentiality": ("confidentiality", "non-disclosure", "nondisclosure", "confidential information", "confidentiality obligations", "secrecy", "protection of confidential information"),
    "Term": ("term", "duration", "agreement term", "term of agreement"),
    "Termination": ("termination", "term and termination", "right to terminate", "termination for cause"),
    "Governing Law": ("governing law", "applicable law", "choice of law", "law and jurisdiction", "governing law and jurisdiction"),
    "Dispute Resolution": ("dispute resolution", "arbitration", "disputes", "mediation"),
    "Indemnification": ("indemnification", "indemnity", "hold harmless", "indemnities"),
    "Limitation of Liability": ("limitation of liability", "liability", "limitation on liability", "liability cap", "exclusion of liability"),
    "Intellectual Property": ("intellectual property", "ip rights", "ownership of ip", "proprietary rights", "intellectual property rights", "ownership"),
    "Payment": ("payment", "fees", "compensation", "fees and payment", "consideration", "pricing", "invoicing", "invoices", "invoice"),
    "Warranties": ("warranties", "representations and warranties", "warranty", "reps and warranties", "representations"),
    "Assignment": ("assignment", "assignability", "assignment and delegation"),
    "Notices": ("notices", "notice"),
    "Force Majeure": ("force majeure", "acts of god"),
    "Entire Agreement": ("entire agreement", "integration", "complete agreement"),
    "Severability": ("severability", "severance"),
    "Waiver": ("waiver", "no waiver"),
    "Non-Compete": ("non-compete", "noncompete", "noncompetition", "non-competition", "covenant not to compete"),
    "Non-Solicitation": ("non-solicit", "non-solicitation", "nonsolicitation", "no solicitation"),
    "Data Protection": ("data protection", "data privacy", "gdpr", "privacy", "personal data", "customer data", "customer content", "protection by provider", "protection by customer"),
    "Insurance": ("insurance",),
    "Counterparts": ("counterparts",),
    "Survival": ("survival", "survival of obligations"),
    "Amendment": ("amendment", "amendments", "modification", "modifications", "changes"),
    "Relationship of the Parties": ("relationship of the parties", "independent contractor", "no partnership", "no agency"),
    "Compliance with Laws": ("compliance with laws", "compliance", "anti-corruption", "anti-bribery", "export controls", "export control"),
    "Publicity": ("publicity", "announcements", "press releases"),
    "Exclusions": ("exclusions", "exceptions", "permitted disclosures", "required disclosures", "exclusions from confidential information"),
    "Remedies": ("remedies", "injunctive relief", "equitable relief", "exclusive remedy", "non-exhaustive remedies", "specific performance"),
    "Restrictions": ("restrictions", "use restrictions", "usage restrictions", "license restrictions", "restrictions and obligations"),
    "Taxes": ("taxes", "tax matters", "withholding"),
    "Reservation of Rights": ("reservation of rights", "reservation of right"),
    "Third-Party Beneficiaries": ("third-party beneficiaries", "third party beneficiaries", "no third-party beneficiary", "no third party beneficiaries"),
    "Feedback": ("feedback", "feedback and usage data"),
    "Miscellaneous": ("miscellaneous", "general terms", "general provisions"),
    "Suspension": ("suspension", "suspension of service", "suspension of services"),
    "Support": ("support", "support services", "technical support", "customer support"),
    "Service Levels": ("service levels", "service level agreement", "sla", "service level"),
}

# Places and their codes, in the order in which contained names are tried.
US_STATES: dict[str, str] = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
OTHER_PLACES: dict[str, str] = {
    "ontario": "CA-ON", "quebec": "CA-QC", "british columbia": "CA-BC", "alberta": "CA-AB", "england and wales": "GB-EAW",
    "england": "GB-ENG", "scotland": "GB-SCT", "wales": "GB-WLS", "northern ireland": "GB-NIR", "united kingdom": "GB", "france": "FR",
    "germany": "DE", "ireland": "IE", "singapore": "SG", "australia": "AU", "india": "IN", "netherlands": "NL", "switzerland": "CH",
    "japan": "JP",
}

# Number words.
NUMBER_WORDS: dict[str, int] = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}

# Lower-case words allowed in a heading.
HEADING_STOPWORDS = ("a", "an", "the", "and", "or", "of", "to", "for", "in", "on", "with", "by", "at", "as", "per", "from", "into", "nor", "but")

# Confidence by clause tier, mapped and not.
TIER_CONFIDENCE: dict[str, tuple[float, float]] = {"h2": (0.95, 0.71), "bold-numbered": (0.85, 0.64), "numbered": (0.80, 0.60), "all-caps": (0.75, 0.56)}

# Confidences of fields.
PARTIES, DATE_LABELED, DATE_KEYWORD, LAW, JURISDICTION, TERM, WEAK, SIGNATORY = 0.90, 0.90, 0.85, 0.85, 0.80, 0.70, 0.60, 0.55
DATE_LABELED_RAW, DATE_KEYWORD_RAW = 0.60, 0.55
LLM_SCALAR, LLM_LIST, LLM_CLAUSE = 0.60, 0.55, 0.50

# Limits.
MAX_AMOUNTS, MAX_TERMS, MAX_SIGNATORIES, MAX_TITLE, MIN_CONTAINED = 30, 50, 12, 90, 5
MAX_FILE_BYTES, MAX_DECODED_BYTES = 100 * 1024 * 1024, 200 * 1024 * 1024
LLM_TEXT, LLM_CLAUSES, LLM_OBLIGATIONS = 16000, 40, 5


def aliases() -> list[tuple[int, str, str]]:
    """(order, key, canonical title); a title is its own first alias, a repeated key keeps its first place."""
    keys: dict[str, str] = {}
    for title, names in CLAUSES.items():
        for key in (title.lower(), *names):
            keys[key] = title
    return [(i, key, title) for i, (key, title) in enumerate(keys.items())]


def places() -> list[tuple[int, str, str]]:
    """(order, name, code)."""
    codes = {name: f"US-{code}" for name, code in US_STATES.items()} | OTHER_PLACES
    return [(i, name, code) for i, (name, code) in enumerate(codes.items())]
