"""Patterns of contract extraction, for Java's engine. Matches must equal them.

All are used with the flags (?Ud): Unicode classes, and only newline ends a line. Those marked
I ignore case as well, those marked M are multiline.
"""

from __future__ import annotations

# Building blocks.
ROMAN = r"(?:(?:XXX|XX|X)(?:IX|IV|VIII|VII|VI|V|III|II|I)?|IX|IV|VIII|VII|VI|V|III|II|I)"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
DATE = (
    r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"
    rf"|(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?(?:{MONTHS})\.?,?\s+\d{{4}})"
)
PARTY_START = r"(?:(?:[Tt]he|its)\s+)?[A-Z\"“(]"

I, M = "(?Udiu)", "(?Udm)"
PLAIN = "(?Ud)"

# Headings of clauses.
H2 = M + r"^##[ \t]+(.+?)[ \t]*$"
BOLD = M + r"^\*\*\s*(?:(?:Article|Section|Sec\.?|Art\.?|Clause|Part|§)\s+\S+\.?|\(\d+\)|\d+(?:\.\d+)*)[\.\):\s]+([^\*\n]+?)\s*\*\*\s*$"
NUMBERED = M + rf"^[ \t]*(?:(?:Article|Section|ARTICLE|SECTION)[ \t]+)?(?:{ROMAN}|\d{{1,2}})\.?[ \t]+([A-Z][A-Za-z][^\n]{{0,58}})[ \t]*$"
ARTICLE = M + rf"^[ \t]*(?:ARTICLE|Article|SECTION|Section)[ \t]+(?:{ROMAN}|\d{{1,2}})[ \t]*[.:–—-]?[ \t]*$"
CAPS = PLAIN + r"(?:^|\n)\n([A-Z][A-Z0-9 \-/&,]{1,}[A-Z0-9])\s*\n\n"
NUMBER_PREFIX = I + rf"^\s*(?:(?:Article|Section|Sec\.?|Art\.?|Clause|Part)\s+(?:{ROMAN}|\d+(?:\.\d+)*)|§\s*\d+(?:\.\d+)*|\(\d+\)|\[\d+\]|\d+(?:\.\d+)+|\d+)[\.\)\]:\s]*"
NOISE_PREFIX = I + r"^(?:table\s+of\s+contents|exhibit|schedule|annex|appendix|attachment|signature\s+page|signatures?|page|recitals?|background|preamble|witnesseth|defining\s+variables)\b"
NOISE_DIGITS = PLAIN + r"\d{4,}"
NOISE_OPENERS = "\"“[{"
NOISE_PLACEHOLDER = PLAIN + r"\[\s*#|#\s*\]|%\s*\]"

# Fields.
EFFECTIVE_LABELED = I + rf"({DATE})\s*\(\s*(?:the\s+)?[\"“]?\s*Effective\s+Date"
EFFECTIVE = I + r"(?:effective(?:\s+date)?(?:\s+(?:as\s+of|date|on))?|dated(?:\s+as\s+of)?|made(?:\s+and\s+entered\s+into)?(?:\s+as\s+of|\s+on)?|entered\s+into(?:\s+as\s+of|\s+on)?|as\s+of)" + rf"[\s:,]+(?:the\s+)?({DATE})"
EXPIRATION = I + r"(?:expir\w*|terminat\w*\s+on|end(?:s|ing)?\s+on|until|through|remain\s+in\s+effect\s+until)" + rf"[\s:,]+(?:the\s+)?({DATE})"
PARTY_BLOCK = PLAIN + rf"(?iu:\b(?:by\s+and\s+between|between)\s+)({PARTY_START}[^\n]{{1,200}}?)\s+and\s+({PARTY_START}[^\n]{{1,200}}?)(?=[\.;\n]|(?iu:\bwhereas\b|\beffective\b|\bdated\b|\bas\s+of\b|\bwitnesseth\b)|$)"
ROLE = r"\(\s*(?:the\s+)?[\"“]?([^\"”()]+?)[\"”]?\s*\)"
LAW = PLAIN + r"(?iu:(?:governed|construed|interpreted|enforced)\b[^.\n]{0,60}?\blaws?\s+of\s+(?:the\s+)?)([A-Z][A-Za-z\.\- ]+?(?:,\s*[A-Z][A-Za-z\.\- ]+?)?)(?=[\.,;\n)]|\s+and\b|\s+without\b|$)"
TERM_LENGTH = I + r"(?:(?:initial\s+)?term|period|duration|in\s+(?:full\s+)?(?:force\s+and\s+)?effect\s+for)[^.\n]{0,40}?\b(\d+|[A-Za-z]+)(?:\s*\(\d+\))?\s+(years?|months?|weeks?|days?)\b"
NOTICE = I + r"\b(\d{1,4}|[A-Za-z]{1,12})(?:\s*\(\d+\))?\s+days?[’'`]?s?\s+(?:prior\s+)?(?:written\s+)?notice"
RENEWS = I + r"automatic(?:ally)?\s+renew|auto-?renew|renew(?:s|ed)?\s+automatically|successive\s+(?:\d+|[A-Za-z]+)[\s-]+(?:year|month)|shall\s+(?:automatically\s+)?renew\s+for"
RENEWS_NOT = I + r"(?:shall|will|does|may)\s+not\s+(?:automatically\s+)?renew|no\s+automatic\s+renewal|not\s+(?:be\s+)?renewed?\s+automatically|shall\s+not\s+(?:be\s+)?(?:automatically\s+)?renewed?"
MONEY = I + r"(?:\$|US\$|USD\s?|EUR\s?|€|£|GBP\s?)\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:\s?(?:million|billion|thousand|bn|m|k))?"
TERM_QUOTED = PLAIN + r"[\"“]([A-Z][A-Za-z0-9][A-Za-z0-9 \-'/&]{1,60})[\"”]"
TERM_PAREN = PLAIN + r"\(\s*(?:the\s+)?[\"“]?([A-Z][A-Za-z0-9][A-Za-z0-9 \-'/&]{1,40})[\"”]?\s*\)"
SIGNATORY = I + r"(?:^|\n)[ \t]*(?:By|Name|Printed\s+Name|Signed\s+by|Authorized\s+Signatory)[ \t]*:[ \t]*([^\n_{}\[\]]{2,60})"
SIGNATORY_TITLE = I + r"(?:^|\n)[ \t]*(?:Title|Its)[ \t]*:[ \t]*([^\n_{}\[\]]{2,60})"
SIGNATURE_LABEL = I + r"^(?:by|name|title|signature|its|date|signed|print)\b"
PLACE_PREFIX = I + r"^\s*(?:the\s+)?(?:state|commonwealth|province|laws?)\s+of\s+"
H1 = M + r"^#\s+(.+?)\s*$"
HTML_TAGS = r"</?(?:p|div|table|tr|td|span|br|h[1-6]|font|b|i)\b"

# What follows a party's name; from the first of each on, the name is cut.
PARTY_CUTS = (
    r",\s+an?\s+\w",
    r"\s+doing\s+business\s+as\b",
    r"\s+d/?b/?a\b",
    r"\s+f/?k/?a\b",
    r"\s+a[n]?\s+\w+\s+(?:corporation|company|partnership|limited)\b",
    r"\s+having\b",
    r"\s+with\s+(?:its\s+)?(?:offices|principal|a\s)\b",
    r"\s+with\s+offices\b",
    r"\s+located\b",
    r"\s+organized\b",
    r"\s+incorporated\b",
    r"\s+whose\b",
    r"\s+together\b",
    r",\s+as\s+\w",
    r"\s+(?:as\s+of|dated|effective)\b",
)

# Date formats in the order in which they are tried (two-digit years are handled apart).
DATE_FORMATS = ("yyyy-MM-dd", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "M/d/yy", "d/M/yyyy")
